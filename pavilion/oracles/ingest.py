from pavilion.oracles.views import big, sql, stamp

_MS = "CAST(epoch_ms({0}) AS VARCHAR)"
_CITY = "CASE WHEN venue <> 'N/A' THEN split_part(venue, ', ', 2) END"
_LAND = "CASE WHEN venue <> 'N/A' THEN split_part(venue, ', ', 3) END"
_DONE = "state = 'Complete'"


def _text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def _done(expr: str) -> str:
    return f"CASE WHEN {_DONE} THEN {_text(expr)} END"


_FLAT = f"""flat AS (
  SELECT match_type AS "matchType", {_text('series_id')} AS "seriesId", series_name AS "seriesName",
    {_text('match_id')} AS "matchId", match_desc AS "matchDesc", match_format AS "matchFormat",
    {_MS.format('start_date')} AS "startDate", {_MS.format('end_date')} AS "endDate", state, status,
    team1 AS team1_name, team2 AS team2_name, 'N' || team1_id AS team1_short, 'N' || team2_id AS team2_short,
    {_text('team1_id')} AS team1_id, {_text('team2_id')} AS team2_id, venue, {_CITY} AS city, {_LAND} AS country,
    {_done('match_id % 300')} AS team1_score, {_done('match_id % 11')} AS team1_wickets, {_done("'20.0'")} AS team1_overs,
    {_done('match_id % 300 + 1')} AS team2_score, {_done('match_id % 11')} AS team2_wickets, {_done("'20.0'")} AS team2_overs,
    {_text('1700000000 + match_id')} AS feed_time
  FROM v_matches)"""
_CANON = f"""SELECT {_text('match_id')} AS match_id, {_text('series_id')} AS series_id, series_name, match_desc, match_type,
    match_format, {stamp('start_date')} AS start_date, {stamp('end_date')} AS end_date, state, status, team1, team2,
    {_text('team1_id')} AS team1_id, {_text('team2_id')} AS team2_id, venue FROM v_matches"""
_YEAR = "strftime(make_timestamp(CAST(\"startDate\" AS BIGINT) * 1000), '%Y-01-01 00:00:00')"
_ODD = "batting_position % 2 = 1"

SQL = {
    "NZ1_flat_matches": sql(f"WITH {_FLAT} SELECT * FROM flat"),
    "NZ2_canonical_from_flat": sql(_CANON),
    "NZ2_canonical_from_raw": sql(_CANON),
    "NZ3_team_names": sql("SELECT match_id, CASE WHEN match_id % 5 < 4 OR match_id % 10 = 9 OR match_id % 20 = 14 THEN team1 END AS team_name FROM v_matches"),
    "NZ4_team_ids": sql(f"""
      SELECT match_id, CASE match_id % 5 WHEN 0 THEN {_text('team1_id')} WHEN 1 THEN {_text('team1_id')}
        WHEN 2 THEN '[{{}},{{"teamName":"' || team1 || '"}}]' WHEN 3 THEN team1
        WHEN 4 THEN CASE WHEN match_id % 20 = 14 THEN '[[],[' || repeat('{{"teamInfo":{{"team":', 4) || '{{"teamInfo":{{"shortName":"' || team1 || '"}}}}'
            || repeat('}}', 8) || ']]' WHEN match_id % 10 = 9 THEN '[[{{"team":{{"teamId":' || team1_id || ',"teamName":"' || team1 || '"}}}}]]' END END AS team_id
      FROM v_matches"""),
    "NZ5_timestamps": sql(f"""
      SELECT match_id, CASE WHEN match_id % 4 < 2 THEN {stamp('start_date')} END AS start_date FROM v_matches"""),
    "NZ6_scorecard_batting": sql("""
      SELECT match_id, innings_id, player_name, runs, balls, fours, sixes, strike_rate, dismissal FROM v_batting"""),
    "NZ7_scorecard_bowling": sql("""
      SELECT match_id, innings_id, player_name, CAST(balls % 7 AS DOUBLE) AS overs, fours AS maidens, runs AS runs_conceded,
        sixes AS wickets, CAST(NULL AS DOUBLE) AS economy FROM v_batting"""),
    "NZ8_scorecard_lines": sql(f"""
      SELECT match_id, innings_id, 'Innings ' || innings_id AS innings, CAST(1 AS BIGINT) AS line, player_name AS batter,
        {_text('runs')} AS runs, {_text('balls')} AS balls, {_text('fours')} AS fours, '' AS sixes,
        printf('%.2f', strike_rate) AS strike_rate, dismissal
      FROM v_batting WHERE {_ODD}
      UNION ALL SELECT match_id, innings_id, 'Innings ' || innings_id, 1, '', '', '', '', '', '', 'not out'
      FROM v_batting WHERE NOT ({_ODD})
      UNION ALL SELECT match_id, innings_id, 'Innings ' || innings_id, 2, '', '', '', {_text('fours')}, '',
        printf('%.2f', strike_rate), dismissal
      FROM v_batting WHERE NOT ({_ODD})
      UNION ALL SELECT match_id, innings_id, 'Innings ' || innings_id, 2, 'Extras', {_text('batting_position')}, '-', '-', '-', '',
        'w ' || sixes || ', nb ' || fours || ', b 0, lb 0' FROM v_batting WHERE {_ODD}"""),
    "NZ9_scorecard_innings": sql(f"""
      SELECT match_id, innings_id, batting_team, bowling_team, {big('runs')} AS runs, wickets, overs,
        {_text('wickets')} AS no_balls, CASE WHEN wickets = 0 THEN 'true' ELSE 'false' END AS declared, 'false' AS follow_on
      FROM v_innings"""),
    "NZ10_squad_players": sql(f"""
      SELECT player_id % 25 AS team_id, external_player_id, player_name, batting_style, bowling_style,
        {_text('player_id + 1000')} AS image_id FROM v_players"""),
    "NZ11_overs": sql(f"""
      SELECT player_id, {big('sum(CASE WHEN overs > 0 THEN 10 * overs + maidens ELSE 0 END)')} AS overs_tenths,
        {big('sum(CASE WHEN overs > 0 THEN 6 * overs + maidens ELSE 0 END)')} AS balls
      FROM v_bowling GROUP BY player_id"""),
    "NZ12_lenient_numbers": sql("""
      SELECT match_id, innings_id, player_id, batting_position, CASE WHEN batting_position > 2 THEN runs END AS runs,
        CASE WHEN batting_position > 2 THEN strike_rate END AS strike_rate FROM v_batting"""),
    "NZ13_residual_fields": sql(f"""
      SELECT match_id, innings_id, player_name, runs, {_text('player_id')} AS bat_id, CAST(NULL AS VARCHAR) AS mapped_field
      FROM v_batting"""),
    "NZ14_venue_parts": sql("""
      SELECT DISTINCT venue AS full_venue, split_part(venue, ', ', 3) AS venue_name, split_part(venue, ', ', 2) AS city,
        split_part(venue, ', ', 3) AS country FROM v_matches WHERE venue IS NOT NULL AND venue <> 'N/A'"""),
    "NZ15_playing_style": sql("""
      SELECT player_id, CASE WHEN meta IS NULL THEN 'N/A'
        ELSE 'Bat: ' || batting_style || ', Bowl: ' || bowling_style END AS playing_style FROM v_players"""),
    "NZ16_series_dim": sql("SELECT DISTINCT series_id, series_name FROM v_matches"),
    "NZ16_team_dim": sql("""
      SELECT team1_id AS team_id, team1 AS team_name FROM v_matches UNION SELECT team2_id, team2 FROM v_matches"""),
    "NZ17_match_cards": sql(f"""
      WITH {_FLAT}
      SELECT "matchId" AS match_id, team1_name || ' vs ' || team2_name AS title, "matchFormat" AS format,
        coalesce(status, 'N/A') AS status, strftime(make_timestamp(CAST("startDate" AS BIGINT) * 1000), '%d %b %Y, %H:%M') AS date,
        coalesce(venue, 'N/A') AS venue, coalesce(city, 'N/A') AS city,
        coalesce(team1_score || '/' || team1_wickets || ' (' || team1_overs || ' ov)', 'Score not available') AS team1_line,
        coalesce(team2_score || '/' || team2_wickets || ' (' || team2_overs || ' ov)', 'Score not available') AS team2_line,
        "matchDesc" AS note FROM flat"""),
    "IO1_read_snapshots": sql(f"""
      WITH {_FLAT}
      SELECT 'recent' AS endpoint, {_YEAR} AS fetched_at, "matchId",
        "seriesName", status, team1_name, venue, feed_time FROM flat"""),
    "IO2_land_bad_bodies": sql("""
      SELECT 'scard' AS endpoint, CAST(match_id AS VARCHAR) AS subject, CAST(429 AS BIGINT) AS status_code,
        '<p>' || coalesce(status, '') || '</p> ' || match_id AS text FROM v_matches"""),
    "IO3_tables": sql("""
      SELECT 'players' AS table_name, count(*) AS record_count FROM v_players
      UNION ALL SELECT 'venues', count(*) FROM v_venues
      UNION ALL SELECT 'matches', count(*) FROM v_matches
      UNION ALL SELECT 'teams', count(*) FROM nation
      UNION ALL SELECT 'batting_stats', count(*) FROM v_batting
      UNION ALL SELECT 'bowling_stats', count(*) FROM v_bowling
      UNION ALL SELECT 'innings', count(*) FROM v_innings"""),
    "IO4_export_csv": sql("""
      SELECT series_name, count(*) AS total_matches, count(DISTINCT team1) AS unique_teams FROM v_matches
      WHERE series_name IS NOT NULL GROUP BY series_name"""),
    "IO5_parametrized_sql": sql("""
      SELECT match_format, count(*) AS wins FROM v_matches WHERE winning_team = 'NATION_7' AND margin <= 40
      GROUP BY match_format"""),
}
