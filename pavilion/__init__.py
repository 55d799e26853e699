"""Match analytics on Spark: feeds to star schema, keyed maintenance, query catalogue."""
