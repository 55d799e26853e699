"""The same questions as plain SQL, to check the Spark plans against another engine."""
