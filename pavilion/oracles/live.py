from pavilion.oracles.views import big, day, mean2, rate2, sql, stamp, total_of_rate

_PLAYER = f"""player_id, external_player_id, player_name, {day('date_of_birth')} AS date_of_birth, country, role,
  batting_style, bowling_style, total_runs, total_wickets, batting_average, bowling_average, meta,
  {stamp('created_at')} AS created_at"""

SQL = {
    "L1_all_players": sql(f"SELECT {_PLAYER} FROM v_players ORDER BY player_name, player_id LIMIT 100"),
    "L2_recent_matches": sql(f"""
      SELECT match_id, series_name, team1, team2, match_format, status, venue, {stamp('start_date')} AS start_date
      FROM v_matches ORDER BY v_matches.start_date DESC, match_id LIMIT 20"""),
    "L3_top_run_scorers": sql(f"""
      SELECT player_name, {big('sum(runs)')} AS total_runs, count(*) AS innings_played,
        {mean2('runs')} AS avg_runs, max(runs) AS highest_score
      FROM v_batting GROUP BY player_name ORDER BY total_runs DESC, player_name LIMIT 20"""),
    "L4_top_wicket_takers": sql(f"""
      SELECT player_name, {big('sum(wickets)')} AS total_wickets, count(*) AS matches,
        {rate2('economy')} AS avg_economy, {total_of_rate('overs')} AS total_overs
      FROM v_bowling WHERE wickets > 0 GROUP BY player_name ORDER BY total_wickets DESC, player_name LIMIT 20"""),
    "L5_matches_by_format": sql("""
      SELECT match_format, count(*) AS match_count, count(DISTINCT team1) + count(DISTINCT team2) AS unique_teams
      FROM v_matches GROUP BY match_format"""),
    "L6_series_statistics": sql(f"""
      SELECT series_name, count(*) AS total_matches, count(DISTINCT team1) AS unique_teams,
        {stamp('min(start_date)')} AS first_match, {stamp('max(start_date)')} AS last_match
      FROM v_matches WHERE series_name IS NOT NULL GROUP BY series_name
      ORDER BY total_matches DESC, series_name LIMIT 25"""),
    "L7_batting_by_format": sql(f"""
      SELECT match_format, count(DISTINCT player_name) AS players, {mean2('runs')} AS avg_runs,
        {rate2('strike_rate')} AS avg_strike_rate, {big('sum(fours)')} AS total_fours, {big('sum(sixes)')} AS total_sixes
      FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id
      WHERE match_format IS NOT NULL GROUP BY match_format"""),
    "L8_century_makers": sql(f"""
      SELECT player_name, runs, balls, strike_rate, team1, team2, match_format, {stamp('start_date')} AS start_date
      FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id WHERE runs >= 100
      ORDER BY runs DESC, b.match_id, innings_id, batting_position, player_id, balls LIMIT 30"""),
    "L9_five_wicket_hauls": sql("""
      SELECT player_name, wickets, runs_conceded, overs, economy, team1, team2, match_format
      FROM v_bowling b JOIN v_matches m ON b.match_id = m.match_id WHERE wickets >= 5
      ORDER BY wickets DESC, economy NULLS FIRST, b.match_id, innings_id, player_id, overs, runs_conceded LIMIT 25"""),
    "L10_table_counts": sql("""
      SELECT 'Players' AS table_name, count(*) AS record_count FROM v_players
      UNION ALL SELECT 'Matches', count(*) FROM v_matches
      UNION ALL SELECT 'Batting Records', count(*) FROM v_batting
      UNION ALL SELECT 'Bowling Records', count(*) FROM v_bowling
      UNION ALL SELECT 'Venues', count(*) FROM v_venues"""),
}
PLAYER = _PLAYER
