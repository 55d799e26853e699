from pavilion.oracles.views import big, day, sql, stamp

_PEOPLE = "external_player_id, player_name, country, role, batting_style, bowling_style"
_ROW = "match_id, innings_id, player_id, batting_position, runs, dismissal"

# Tables by name: the view that holds them, and the columns with their types.
_TABLES = {
    "players": ("v_players", "player_id bigint, external_player_id string, player_name string, date_of_birth date, country string, "
                "role string, batting_style string, bowling_style string, total_runs bigint, total_wickets bigint, "
                "batting_average double, bowling_average double, meta string, created_at timestamp_ntz"),
    "venues": ("v_venues", "venue_id bigint, venue_name string, city string, country string, capacity bigint"),
    "teams": ("(SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, r_name AS country "
              "FROM nation JOIN region ON n_regionkey = r_regionkey)", "team_id bigint, team_name string, country string"),
    "matches": ("v_matches", "match_id bigint, series_id bigint, series_name string, match_type string, match_desc string, "
                "match_format string, start_date timestamp_ntz, end_date timestamp_ntz, state string, venue_id bigint, venue string, "
                "margin bigint, margin_type string, victory_margin string, toss_decision string, status string, team1 string, "
                "team1_id bigint, team2 string, team2_id bigint, toss_winner string, winning_team string"),
    "batting_stats": ("v_batting", "match_id bigint, innings_id string, player_id bigint, batting_position bigint, runs bigint, "
                      "balls bigint, fours bigint, sixes bigint, strike_rate double, dismissal string"),
    "bowling_stats": ("v_bowling", "match_id bigint, innings_id string, player_id bigint, overs double, maidens bigint, "
                      "runs_conceded bigint, wickets bigint, economy double"),
    "innings": ("v_innings", "match_id bigint, innings_id string, batting_team string, bowling_team string, runs bigint, "
                "wickets bigint, overs double"),
}


def _row_text(cols: str) -> str:
    return "concat_ws(' | ', " + ", ".join(f"coalesce(CAST({x.split()[0]} AS VARCHAR), 'NULL')" for x in cols.split(", ")) + ")"


SQL = {
    "UP1_match_upsert": sql(f"""
      SELECT match_id, status, match_format,
        CASE WHEN state = 'Complete' THEN {stamp('start_date')} ELSE {stamp('end_date')} END AS created_at FROM v_matches"""),
    "UP2_team_upsert": sql("""
      WITH known AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name, r_name AS country
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'),
      seen AS (SELECT team1_id AS team_id, team1 AS name FROM v_matches UNION SELECT team2_id, team2 FROM v_matches)
      SELECT coalesce(known.team_id, seen.team_id) AS team_id, coalesce(name, 'old ' || n_name) AS team_name, country
      FROM known FULL JOIN seen ON known.team_id = seen.team_id"""),
    "UP2_series_upsert": sql("""
      SELECT DISTINCT series_id, series_name, CASE WHEN match_type = 'Women' THEN match_type END AS series_type FROM v_matches"""),
    "UP3_player_insert_ignore": sql(f"""
      SELECT {_PEOPLE} FROM v_players WHERE role IS NOT NULL
      UNION ALL SELECT external_player_id, lower(player_name) || ' v1', country, NULL, NULL, NULL FROM v_players WHERE role IS NULL"""),
    "UP4_append": sql(f"""
      SELECT dismissal, 2 * count(*) AS n, {big('2 * sum(runs)')} AS runs FROM v_batting GROUP BY dismissal"""),
    "UP4_replace": sql(f"""
      SELECT {_ROW.replace('runs', 'runs + 1 AS runs')} FROM v_batting WHERE dismissal = 'not out'
      UNION ALL SELECT {_ROW} FROM v_batting WHERE dismissal = 'out'
        AND (match_id, innings_id) NOT IN (SELECT match_id, innings_id FROM v_batting WHERE dismissal = 'not out')"""),
    "UP5_innings_if_absent": sql(f"""
      SELECT match_id, innings_id, batting_team, {big('CASE WHEN wickets > 1 THEN runs ELSE runs + 1 END')} AS runs, wickets
      FROM v_innings"""),
    "UP5_venues_if_absent": sql("""
      WITH texts AS (SELECT DISTINCT split_part(venue, ', ', 3) AS name, split_part(venue, ', ', 2) AS city FROM v_matches
        WHERE venue IS NOT NULL AND venue <> 'N/A')
      SELECT venue_name, city, country, capacity FROM v_venues
      UNION ALL SELECT name, min(city), name, NULL FROM texts WHERE name NOT IN (SELECT venue_name FROM v_venues) GROUP BY name"""),
    "UP6_squad_by_name": sql("""
      SELECT external_player_id, player_name, '' AS country, '' AS role, batting_style, bowling_style FROM v_players"""),
    "UP6_match_squads": sql("""
      SELECT player_id % 25 AS team_id, external_player_id, player_name, batting_style, bowling_style FROM v_players"""),
    "UP7_patch": sql("""
      SELECT player_id, player_name, country, coalesce(role, 'Batsman') AS role,
        CASE WHEN total_wickets > 50 THEN total_wickets WHEN role IS NULL THEN 7 ELSE total_runs END AS total_runs, total_wickets,
        CASE WHEN total_wickets > 50 THEN CAST(51.25 AS DOUBLE) ELSE batting_average END AS batting_average,
        CASE WHEN total_wickets > 50 THEN CAST(19.5 AS DOUBLE) ELSE bowling_average END AS bowling_average
      FROM v_players"""),
    "UP8_insert_rows": sql("""
      SELECT count(*) AS n, count(*) AS ids,
        max(player_id) FILTER (role IS NOT NULL) + count(*) FILTER (role IS NULL) AS highest,
        count(DISTINCT player_name) AS names, count(*) FILTER (role IS NULL) AS stamped FROM v_players"""),
    "UP9_delete": sql(f"""
      SELECT {_ROW} FROM v_batting WHERE match_id NOT IN (SELECT match_id FROM v_matches WHERE winning_team IS NULL)"""),
    "UP10_sync_summary": sql("""
      SELECT 'Matches Synced' AS metric, count(DISTINCT match_id) AS n FROM v_matches
      UNION ALL SELECT 'Players Synced', count(*) FROM v_players WHERE role IS NULL
      UNION ALL SELECT 'Scorecards Synced', count(DISTINCT match_id) FROM v_batting"""),
    "EN1_missing_attributes": sql(f"""
      SELECT player_id, external_player_id, player_name, {day('date_of_birth')} AS date_of_birth, country, role, meta
      FROM v_players WHERE v_players.date_of_birth IS NULL OR country IS NULL OR country = '' OR role IS NULL OR role = ''
      ORDER BY player_id LIMIT 100"""),
    "EN2_derived_roles": sql("""
      SELECT player_id, CASE WHEN meta IS NULL THEN 'Batsman' WHEN batting_style <> '' AND bowling_style <> '' THEN 'All-rounder'
        WHEN batting_style <> '' THEN 'Batsman' WHEN bowling_style <> '' THEN 'Bowler' ELSE 'Batsman' END AS role FROM v_players"""),
    "EN3_enriched_players": sql(f"""
      SELECT external_player_id, player_name, CASE WHEN role = 'Batsman' THEN '1990-05-06' ELSE {day('date_of_birth')} END AS date_of_birth,
        CASE WHEN role = 'All-rounder' THEN 'of ' || country ELSE country END AS country,
        CASE WHEN role IS NOT NULL THEN role WHEN meta IS NULL THEN 'Batsman'
          WHEN batting_style <> '' AND bowling_style <> '' THEN 'All-rounder'
          WHEN batting_style = '' AND bowling_style <> '' THEN 'Bowler' ELSE 'Batsman' END AS role FROM v_players"""),
    "DQ1_table_status": sql("""
      WITH s AS (SELECT 'players' AS table_name, count(*) AS total FROM v_players
        UNION ALL SELECT 'matches', count(*) FROM v_matches UNION ALL SELECT 'batting_stats', count(*) FROM v_batting
        UNION ALL SELECT 'bowling_stats', count(*) FROM v_bowling UNION ALL SELECT 'venues', count(*) FROM v_venues
        UNION ALL SELECT 'undecided', 0)
      SELECT table_name, CAST(total AS BIGINT) AS total, total = 0 AS is_empty, 'has data' AS database_state FROM s"""),
    "DQ2_player_completeness": sql("""
      SELECT count(*) AS total, count(*) FILTER (player_name IS NULL OR player_name = '') AS null_names,
        count(*) FILTER (player_name = 'player_name') AS placeholder_names,
        count(*) FILTER (country IS NULL OR country = '') AS null_country FROM v_players"""),
    "DQ3_valid_players": sql("""
      SELECT player_id, player_name, country, role FROM v_players
      WHERE player_name IS NOT NULL AND player_name <> '' AND player_name <> 'player_name' ORDER BY player_id LIMIT 10"""),
    "DQ4_match_coverage": sql(f"""
      SELECT count(*) AS total_matches, count(DISTINCT series_name) AS series_count, {stamp('max(start_date)')} AS latest_match
      FROM v_matches"""),
    "DQ5_column_profile": sql(" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null FROM {view}"
        for name, (view, cols) in _TABLES.items() for c, kind in (x.split() for x in cols.split(", ")))),
    "DQ6_sample_rows": sql(" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, row FROM (SELECT {_row_text(cols)} AS row FROM {view} "
        f"ORDER BY {', '.join(x.split()[0] + ' NULLS FIRST' for x in cols.split(', '))} LIMIT 3)"
        for name, (view, cols) in _TABLES.items())),
    "ST2_sync_tables": sql(f"""
      SELECT 'matches ' || match_format AS part, count(*) AS n, count(DISTINCT team1) AS names, {stamp('max(start_date)')} AS latest
      FROM v_matches GROUP BY match_format
      UNION ALL SELECT 'series', count(DISTINCT series_id), count(DISTINCT series_name), NULL FROM v_matches
      UNION ALL SELECT 'teams', count(*), count(*), NULL
        FROM (SELECT team1_id FROM v_matches UNION SELECT team2_id FROM v_matches)
      UNION ALL SELECT 'players', count(*), count(DISTINCT player_name), NULL FROM v_players"""),
    "ST2_sync_scorecards": sql(f"""
      SELECT player_name, count(*) AS rows_loaded, {big('sum(runs)')} AS runs, max(strike_rate) AS best_rate
      FROM v_batting GROUP BY player_name"""),
    "ST3_latest_state": """
      SELECT user_id, event_id, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "ST4_live_counts": """
      SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(DISTINCT event_id) AS n
      FROM events GROUP BY date_trunc('hour', ts), event_type""",
}
