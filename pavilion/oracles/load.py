"""All SQL counterparts in one dict."""

from pavilion.oracles import analysis, ingest, live, pages, statistics, upkeep


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (live, pages, statistics, analysis, ingest, upkeep):
        out.update(part.SQL)
    # Stored and compacted tables must give the same answer; there a player is known by name.
    for name in ("L7_batting_by_format", "S14_bowlers_at_venues", "S16_yearly_form", "S20_format_profile"):
        out[name.replace("_", "_stored_", 1)] = out[name].replace("b.player_id", "b.player_name")
    for kind, name in (("P7_batting", "P7_stored_batting_career"), ("P8_bowling", "P8_stored_bowling_career")):
        out[name] = f"SELECT * EXCLUDE (player_id) FROM ({out[f'{kind}_career']}) AS career"
    out["ST1_stream_matches"] = out["IO1_read_snapshots"]  # the stream must give the batch answer
    return out
