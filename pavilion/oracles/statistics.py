from pavilion.oracles.views import AS_OF, big, half_up, mean, rate, sql, stamp, total_of_rate

_SIDES = """
  SELECT 1 AS side, team1 AS team_name, status FROM v_matches WHERE team1 IS NOT NULL
  UNION ALL SELECT 2, team2, status FROM v_matches WHERE team2 IS NOT NULL"""
_WON = big("coalesce(sum(CASE WHEN status ILIKE team_name || '%won%' THEN 1 ELSE 0 END), 0)")
_CLOSE = " OR ".join(
    f"status ILIKE '{p}'" for p in ("%won by 1 run%", "%won by 2 run%", "%won by 1 wicket%", "%won by 2 wicket%", "%tied%")
)
_BOTH = f"""both_sides AS (
  SELECT coalesce(a.player_name, b.player_name) AS player_name, coalesce(batting_innings, 0) AS batting_innings,
    coalesce(total_runs, 0) AS total_runs, coalesce(bowling_matches, 0) AS bowling_matches,
    coalesce(total_wickets, 0) AS total_wickets
  FROM (SELECT player_name, count(*) AS batting_innings, {big('sum(runs)')} AS total_runs FROM v_batting GROUP BY player_name) a
  FULL JOIN (SELECT player_name, count(*) AS bowling_matches, {big('sum(wickets)')} AS total_wickets FROM v_bowling GROUP BY player_name) b
  ON a.player_name = b.player_name)"""

SQL = {
    "M10_team_summary": sql(f"""
      WITH sides AS ({_SIDES})
      SELECT team_name, matches_played, wins FROM (
        SELECT side, team_name, count(*) AS matches_played, {_WON} AS wins FROM sides GROUP BY side, team_name)
      ORDER BY wins DESC, team_name, side LIMIT 20"""),
    "M10_team_summary_total": sql(f"""
      WITH sides AS ({_SIDES})
      SELECT team_name, count(*) AS matches_played, {_WON} AS wins FROM sides GROUP BY team_name
      ORDER BY wins DESC, team_name LIMIT 20"""),
    "M11_highest_strike_rates": sql(f"""
      SELECT player_name, count(*) AS innings, {big('sum(runs)')} AS total_runs, {big('sum(balls)')} AS total_balls,
        {rate('strike_rate')} AS avg_strike_rate, max(strike_rate) AS highest_strike_rate
      FROM v_batting WHERE balls >= 30 AND strike_rate > 0 GROUP BY player_name HAVING sum(balls) >= 100
      ORDER BY avg_strike_rate DESC, player_name LIMIT 20"""),
    "M12_best_economy": sql(f"""
      SELECT player_name, count(*) AS matches, {big('sum(wickets)')} AS total_wickets,
        {total_of_rate('overs')} AS total_overs, {rate('economy')} AS avg_economy, {big('sum(maidens)')} AS total_maidens
      FROM v_bowling WHERE overs >= 3 AND economy > 0 GROUP BY player_name HAVING sum(overs) >= 10
      ORDER BY avg_economy, player_name LIMIT 20"""),
    "M13_result_distribution": sql(f"""
      SELECT CASE WHEN status ILIKE '%won by%runs%' THEN 'Won by Runs' WHEN status ILIKE '%won by%wicket%' THEN 'Won by Wickets'
          WHEN status ILIKE '%tied%' THEN 'Tied' WHEN status ILIKE '%abandoned%' THEN 'Abandoned'
          WHEN status ILIKE '%no result%' THEN 'No Result' ELSE 'Other' END AS result_type,
        count(*) AS match_count, {half_up('100 * count(*)', '(SELECT count(*) FROM v_matches)')} AS percentage
      FROM v_matches WHERE status IS NOT NULL GROUP BY result_type"""),
    "M14_venue_statistics": sql("""
      SELECT venue, count(*) AS matches_played, count(DISTINCT series_name) AS series_hosted,
        count(DISTINCT match_format) AS formats_played
      FROM v_matches WHERE venue IS NOT NULL AND venue <> 'N/A' GROUP BY venue
      ORDER BY matches_played DESC, venue LIMIT 25"""),
    "M15_player_consistency": sql(f"""
      SELECT player_name, count(*) AS innings, {mean('runs')} AS avg_runs,
        sqrt(CAST(count(runs) * sum(runs * runs) - sum(runs) * sum(runs) AS DOUBLE)) / count(runs) AS std_dev_runs,
        min(runs) AS min_score, max(runs) AS max_score
      FROM v_batting GROUP BY player_name HAVING count(*) >= 5
      ORDER BY std_dev_runs NULLS FIRST, player_name LIMIT 20"""),
    "M16_boundary_hitters": sql(f"""
      SELECT player_name, count(*) AS innings, {big('sum(fours)')} AS total_fours, {big('sum(sixes)')} AS total_sixes,
        {big('sum(fours) + sum(sixes)')} AS total_boundaries, {big('sum(runs)')} AS total_runs
      FROM v_batting GROUP BY player_name ORDER BY total_boundaries DESC, player_name LIMIT 20"""),
    "M17_recent_form": sql(f"""
      SELECT player_name, count(*) AS recent_innings, {mean('runs')} AS avg_runs, {rate('strike_rate')} AS avg_strike_rate,
        {big('sum(fours)')} AS fours, {big('sum(sixes)')} AS sixes
      FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id
      WHERE start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
      GROUP BY player_name HAVING count(*) >= 3 ORDER BY avg_runs DESC, player_name LIMIT 20"""),
    "M18_bowling_variations": sql(f"""
      SELECT player_name, count(*) AS matches, {mean('wickets')} AS avg_wickets_per_match, {rate('economy')} AS avg_economy,
        {big('sum(wickets)')} AS total_wickets, {rate('overs')} AS avg_overs
      FROM v_bowling WHERE overs > 0 GROUP BY player_name HAVING count(*) >= 5
      ORDER BY avg_wickets_per_match DESC, player_name LIMIT 20"""),
    "M19_batting_and_bowling": sql(f"WITH {_BOTH} SELECT * FROM both_sides"),
    "M19_all_rounders": sql(f"""
      WITH {_BOTH} SELECT * FROM both_sides WHERE total_runs > 100 AND total_wickets > 5
      ORDER BY total_runs + 20 * total_wickets DESC, player_name LIMIT 20"""),
    "M20_best_by_format": sql("""
      WITH j AS (SELECT match_format, player_name, runs, balls, strike_rate, team1, team2
        FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id)
      SELECT * FROM j WHERE (match_format, runs) IN (SELECT match_format, max(runs) FROM j GROUP BY match_format)"""),
    "M21_maidens": sql(f"""
      SELECT player_name, {big('sum(maidens)')} AS total_maidens, {total_of_rate('overs')} AS total_overs,
        {half_up('100 * sum(maidens)', big('sum(overs)'))} AS maiden_percentage, count(*) AS matches
      FROM v_bowling WHERE overs > 0 GROUP BY player_name HAVING sum(maidens) > 0
      ORDER BY total_maidens DESC, player_name LIMIT 20"""),
    "M22_close_matches": sql(f"""
      SELECT match_id, team1, team2, status, match_format, venue, {stamp('start_date')} AS start_date
      FROM v_matches WHERE {_CLOSE} ORDER BY v_matches.start_date DESC, match_id LIMIT 25"""),
    "M23_player_summary": sql("""
      SELECT count(*) AS total_players,
        count(DISTINCT CASE WHEN meta LIKE '%batting_style%' THEN player_name END) AS batsmen_count,
        count(DISTINCT CASE WHEN meta LIKE '%bowling_style%' THEN player_name END) AS bowlers_count,
        count(DISTINCT country) AS countries_represented FROM v_players"""),
    "M24_match_completeness": sql("""
      SELECT 'Total Matches' AS metric, count(*) AS count FROM v_matches
      UNION ALL SELECT 'Matches with Scores', count(DISTINCT match_id) FROM v_batting
      UNION ALL SELECT 'Matches with Bowling Data', count(DISTINCT match_id) FROM v_bowling
      UNION ALL SELECT 'Complete Match Records', count(DISTINCT match_id) FROM v_matches
        WHERE match_id IN (SELECT match_id FROM v_batting) AND match_id IN (SELECT match_id FROM v_bowling)"""),
}
