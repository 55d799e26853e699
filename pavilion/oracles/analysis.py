from pavilion.oracles.views import AS_OF, big, half_up, mean, rate, sql, stamp

_B = "v_batting b JOIN v_matches m ON b.match_id = m.match_id"
_STANDS = """stands AS (
  SELECT a.innings_id, a.batting_position AS first_position, a.player_id AS player1_id, b.player_id AS player2_id, a.runs AS runs1, b.runs AS runs2,
    a.runs + b.runs AS partnership_runs
  FROM v_batting a JOIN v_batting b ON a.innings_id = b.innings_id AND a.batting_position + 1 = b.batting_position)"""


def _won(left: str, right: str) -> str:
    return big(f"coalesce(sum(CASE WHEN {left} = {right} THEN 1 ELSE 0 END), 0)")


def _close(cond: str) -> str:
    return sql(f"""
      SELECT player_name, count(DISTINCT b.match_id) AS close_matches, {mean('b.runs')} AS avg_runs,
        {_won('winning_team', 'batting_team')} AS matches_won
      FROM v_batting b JOIN v_innings i ON b.innings_id = i.innings_id JOIN v_matches m ON i.match_id = m.match_id
      WHERE {cond} GROUP BY b.player_id, player_name""")


def _form(avg: str) -> str:
    return (f"CASE WHEN {avg} > 40 THEN 'Excellent Form' WHEN {avg} > 30 THEN 'Good Form' "
            f"WHEN {avg} > 15 THEN 'Average Form' ELSE 'Poor Form' END")


def _pairs(source: str) -> str:
    return sql(f"""
      SELECT team1 AS team_a, team2 AS team_b, count(*) AS matches_played, {_won('winning_team', 'team1')} AS team_a_wins,
        {_won('winning_team', 'team2')} AS team_b_wins,
        {half_up('100 * count(*) FILTER (winning_team = team1)', 'count(*)')} AS team_a_win_percent
      FROM {source} WHERE start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 3 YEAR AND winning_team IS NOT NULL
      GROUP BY team1, team2 HAVING count(*) >= 5""")


_RANKED = """last_rows AS (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY innings_id DESC, batting_position DESC, runs DESC, balls DESC) AS rn
  FROM v_batting)"""
_ID = "player_id, player_name"

SQL = {
    "S1_players_of_country": sql("SELECT player_name, role, batting_style, bowling_style FROM v_players WHERE country = 'NATION_3'"),
    "S2_last_week": sql(f"""
      SELECT match_id, match_desc, team1, team2, venue_name, city, {stamp('start_date')} AS start_date
      FROM v_matches m LEFT JOIN v_venues v ON m.venue_id = v.venue_id
      WHERE m.start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"""),
    "S3_career_runs_and_centuries": sql("""
      SELECT player_name, total_runs, batting_average,
        (SELECT count(*) FROM v_batting b WHERE b.player_id = p.player_id AND b.runs >= 100) AS centuries
      FROM v_players p ORDER BY total_runs DESC NULLS LAST, player_id LIMIT 10"""),
    "S4_large_venues": sql("SELECT venue_name, city, country, capacity FROM v_venues WHERE capacity > 30000"),
    "S5_wins_per_team": sql("""
      SELECT winning_team, count(*) AS matches_won FROM v_matches WHERE winning_team IS NOT NULL GROUP BY winning_team"""),
    "S6_players_per_role": sql("SELECT role, count(*) AS player_count FROM v_players WHERE role IS NOT NULL GROUP BY role"),
    "S7_highest_score_by_format": sql("""
      SELECT match_format, max(b.runs) AS highest_score
      FROM v_batting b JOIN v_innings i ON b.innings_id = i.innings_id JOIN v_matches m ON i.match_id = m.match_id
      GROUP BY match_format"""),
    "S8_matches_of_year": sql(f"""
      SELECT match_desc, min(team1) AS team1, min(team2) AS team2, count(*) AS matches_in_series,
        {stamp('min(start_date)')} AS first_match
      FROM v_matches WHERE year(start_date) = 1996 GROUP BY match_desc"""),
    "S9_career_all_rounders": sql("""
      SELECT player_name, total_runs, total_wickets, role FROM v_players
      WHERE total_runs > 1000 AND total_wickets > 50 AND role = 'All-rounder'"""),
    "S10_last_finished": sql(f"""
      SELECT match_id, match_desc, team1, team2, winning_team, victory_margin, margin_type, venue_name,
        {stamp('start_date')} AS start_date
      FROM v_matches m LEFT JOIN v_venues v ON m.venue_id = v.venue_id WHERE winning_team IS NOT NULL
      ORDER BY m.start_date DESC, match_id LIMIT 20"""),
    "S11_runs_across_formats": sql(f"""
      SELECT player_name, count(DISTINCT match_format) AS format_count, min(batting_average) AS batting_average,
        {big("sum(CASE WHEN match_format = '1-URGENT' THEN b.runs ELSE 0 END)")} AS test_runs,
        {big("sum(CASE WHEN match_format = '2-HIGH' THEN b.runs ELSE 0 END)")} AS odi_runs,
        {big("sum(CASE WHEN match_format = '3-MEDIUM' THEN b.runs ELSE 0 END)")} AS t20i_runs
      FROM v_players p JOIN (SELECT player_id, innings_id, runs FROM v_batting) b ON p.player_id = b.player_id
        JOIN v_innings i ON b.innings_id = i.innings_id JOIN v_matches m ON i.match_id = m.match_id
      GROUP BY p.player_id, player_name HAVING count(DISTINCT match_format) >= 2"""),
    "S12_wins_by_country": sql("""
      SELECT winning_team, country, count(*) AS wins FROM v_matches m LEFT JOIN v_venues v ON m.venue_id = v.venue_id
      WHERE winning_team IS NOT NULL GROUP BY winning_team, country"""),
    "S13_century_stands": sql(f"""
      WITH {_STANDS} SELECT * FROM stands WHERE partnership_runs >= 100"""),
    "S14_bowlers_at_venues": sql(f"""
      SELECT b.player_id, venue_name, count(DISTINCT m.match_id) AS matches_at_venue, {rate('economy')} AS avg_economy,
        {big('sum(b.wickets)')} AS total_wickets
      FROM v_bowling b JOIN v_innings i ON b.innings_id = i.innings_id JOIN v_matches m ON i.match_id = m.match_id
        JOIN v_venues v ON m.venue_id = v.venue_id
      WHERE b.overs >= 4 GROUP BY b.player_id, v.venue_id, venue_name HAVING count(DISTINCT m.match_id) >= 3"""),
    "S15_close_match_players": _close("margin < 50"),
    "S16_yearly_form": sql(f"""
      SELECT player_name, year(start_date) AS year, count(*) AS matches, {mean('runs')} AS avg_runs,
        {rate('strike_rate')} AS avg_strike_rate
      FROM {_B} WHERE year(start_date) >= 1996 GROUP BY player_id, player_name, year(start_date) HAVING count(*) >= 5"""),
    "S17_toss_advantage": sql(f"""
      SELECT toss_decision, count(*) AS total_matches, {_won('winning_team', 'toss_winner')} AS wins_by_toss_winner,
        {half_up('100 * count(*) FILTER (winning_team = toss_winner)', 'count(*)')} AS win_percentage
      FROM v_matches WHERE toss_winner IS NOT NULL AND toss_decision IS NOT NULL GROUP BY toss_decision"""),
    "S18_limited_overs_economy": sql(f"""
      SELECT player_name, count(DISTINCT m.match_id) AS matches, {rate('economy')} AS avg_economy,
        {big('sum(b.wickets)')} AS total_wickets, {rate('b.overs')} AS avg_overs
      FROM v_bowling b JOIN v_innings i ON b.innings_id = i.innings_id JOIN v_matches m ON i.match_id = m.match_id
      WHERE match_format IN ('2-HIGH', '3-MEDIUM') GROUP BY b.player_id, player_name
      HAVING count(DISTINCT m.match_id) >= 10 AND avg(b.overs) >= 2"""),
    "S19_consistency_since": sql(f"""
      WITH career AS (SELECT player_id, CAST(sum(runs) AS DOUBLE) / count(runs) AS centre FROM v_batting GROUP BY player_id),
      recent AS (SELECT player_id, player_name, count(*) AS innings, {mean('runs')} AS avg_runs,
          CAST(count(runs) * sum(runs * runs) - sum(runs) * sum(runs) AS DOUBLE)
            / (CAST(count(runs) AS DOUBLE) * CAST(count(runs) AS DOUBLE)) AS own
        FROM {_B} WHERE balls >= 10 AND year(start_date) >= 1999 GROUP BY player_id, player_name)
      SELECT player_name, innings, avg_runs, sqrt(own + (avg_runs - centre) * (avg_runs - centre)) AS std_dev
      FROM recent JOIN career ON recent.player_id = career.player_id"""),
    "S20_format_profile": sql(f"""
      SELECT player_name, count(*) FILTER (match_format = '1-URGENT') AS test_matches,
        count(*) FILTER (match_format = '2-HIGH') AS odi_matches, count(*) FILTER (match_format = '3-MEDIUM') AS t20i_matches,
        count(*) AS total_matches, {mean('runs', "match_format = '1-URGENT'")} AS test_avg,
        {mean('runs', "match_format = '2-HIGH'")} AS odi_avg, {mean('runs', "match_format = '3-MEDIUM'")} AS t20i_avg
      FROM {_B} GROUP BY player_id, player_name HAVING count(*) >= 20"""),
    "S21_weighted_score": sql(f"""
      WITH sr AS (SELECT player_id, {rate('strike_rate')} AS sr FROM v_batting GROUP BY player_id),
      points AS (SELECT player_name,
          total_runs * CAST(0.01 AS DOUBLE) + batting_average * CAST(0.5 AS DOUBLE) + coalesce(sr, 0) * CAST(0.3 AS DOUBLE) AS batting_points,
          total_wickets * 2 + (50 - bowling_average) * CAST(0.5 AS DOUBLE) AS bowling_points
        FROM v_players p LEFT JOIN sr ON p.player_id = sr.player_id WHERE total_runs > 0 OR total_wickets > 0)
      SELECT *, batting_points + bowling_points AS total_points FROM points"""),
    "S22_head_to_head": _pairs("v_matches"),
    "S23_recent_form": sql(f"""
      WITH {_RANKED}
      SELECT player_name, {mean('runs', 'rn <= 5')} AS last_5_avg, {mean('runs', 'rn <= 10')} AS last_10_avg,
        {rate('strike_rate')} AS recent_sr, {_form(mean('runs'))} AS form_status
      FROM last_rows GROUP BY player_id, player_name"""),
    "S24_partnerships": sql(f"""
      WITH {_STANDS}
      SELECT player1_id AS player1, player2_id AS player2, count(*) AS partnership_count,
        {mean('partnership_runs')} AS avg_partnership_runs, max(partnership_runs) AS highest_partnership,
        count(*) FILTER (partnership_runs >= 50) AS good_partnerships
      FROM stands GROUP BY player1_id, player2_id HAVING count(*) >= 5"""),
    "P10_best_partnerships": sql(f"""
      WITH {_STANDS}, top AS (
        SELECT p1.player_name || ' & ' || p2.player_name AS partnership_pair, count(*) AS total_partnerships,
          {mean('partnership_runs')} AS avg_partnership_runs, max(partnership_runs) AS highest_partnership,
          count(*) FILTER (partnership_runs >= 50) AS fifty_plus_partnerships,
          {half_up('100 * count(*) FILTER (partnership_runs >= 50)', 'count(*)')} AS success_rate
        FROM stands JOIN v_players p1 ON p1.player_id = player1_id JOIN v_players p2 ON p2.player_id = player2_id
        GROUP BY player1_id, player2_id, p1.player_name, p2.player_name HAVING count(*) >= 2
        ORDER BY avg_partnership_runs DESC, partnership_pair LIMIT 20)
      SELECT *, row_number() OVER (ORDER BY avg_partnership_runs DESC, partnership_pair) AS rank FROM top"""),
    "S25_period_trend": sql(f"""
      SELECT player_name, strftime(start_date, '%Y-Q%w') AS quarter, count(*) AS matches, {mean('runs')} AS avg_runs,
        {rate('strike_rate')} AS avg_sr,
        CASE WHEN {mean('runs')} > 35 THEN 'Ascending' WHEN {mean('runs')} < 20 THEN 'Declining' ELSE 'Stable' END AS trajectory
      FROM {_B} WHERE start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 2 YEAR AND balls >= 3
      GROUP BY player_id, player_name, quarter HAVING count(*) >= 3"""),
    "X1_format_runs_and_centuries": sql(f"""
      SELECT player_name, {big('sum(runs)')} AS total_runs,
        {half_up('sum(runs)', "nullif(count(*) FILTER (dismissal <> 'not out'), 0)")} AS batting_average,
        count(*) FILTER (runs >= 100) AS centuries
      FROM {_B} WHERE match_format = '2-HIGH' GROUP BY player_id, player_name
      ORDER BY total_runs DESC, player_name, player_id LIMIT 10"""),
    "X2_series_of_year": sql(f"""
      WITH held AS (SELECT series_name, country, count(*) AS n FROM v_matches m JOIN v_venues v ON m.venue_id = v.venue_id
          GROUP BY series_name, country),
      host AS (SELECT series_name, country AS host_country FROM held
          QUALIFY row_number() OVER (PARTITION BY series_name ORDER BY n DESC, country DESC) = 1),
      s AS (SELECT series_name, min(match_type) AS match_type, min(start_date) AS first_day, count(*) AS total_matches
          FROM v_matches WHERE series_name IS NOT NULL GROUP BY series_name)
      SELECT s.series_name, host_country, match_type, {stamp('first_day')} AS start_date, total_matches
      FROM s LEFT JOIN host ON s.series_name = host.series_name WHERE year(first_day) = 1995"""),
    "X3_home_and_away": sql("""
      WITH lands AS (SELECT n_name AS team, r_name AS land FROM nation JOIN region ON n_regionkey = r_regionkey),
      sides AS (SELECT team1 AS team, team2 AS other, winning_team, venue_id FROM v_matches
        UNION ALL SELECT team2, team1, winning_team, venue_id FROM v_matches)
      SELECT sides.team, CASE WHEN v.country = own.land THEN 'home' WHEN v.country = foe.land THEN 'away' ELSE 'neutral' END AS setting,
        count(*) AS matches, count(*) FILTER (winning_team = sides.team) AS wins
      FROM sides LEFT JOIN v_venues v ON sides.venue_id = v.venue_id LEFT JOIN lands own ON own.team = sides.team
        LEFT JOIN lands foe ON foe.team = other GROUP BY ALL"""),
    "X4_close_match_players": _close("(margin_type = 'runs' AND margin < 50) OR (margin_type = 'wickets' AND margin < 5)"),
    "X5_format_ranking": sql(f"""
      WITH bat AS (SELECT match_format, player_name, CAST(sum(runs) AS DOUBLE) AS r,
          CAST(sum(runs) AS DOUBLE) / nullif(count(*) FILTER (dismissal <> 'not out'), 0) AS a, {rate('strike_rate')} AS sr
        FROM {_B} GROUP BY match_format, player_name),
      bowl AS (SELECT match_format, player_name, CAST(sum(wickets) AS DOUBLE) AS w,
          CAST(sum(runs_conceded) AS DOUBLE) / nullif(CAST(sum(wickets) AS DOUBLE), 0) AS c
        FROM v_bowling b JOIN v_matches m ON b.match_id = m.match_id GROUP BY match_format, player_name),
      points AS (SELECT match_format, player_name,
          coalesce(r, 0) * CAST(0.01 AS DOUBLE) + coalesce(a, 0) * CAST(0.5 AS DOUBLE) + coalesce(sr, 0) * CAST(0.3 AS DOUBLE) AS batting_points,
          coalesce(w, 0) * CAST(2 AS DOUBLE) + coalesce((CAST(50 AS DOUBLE) - c) * CAST(0.5 AS DOUBLE), 0) AS bowling_points,
          CAST(0 AS DOUBLE) AS fielding_points
        FROM bat FULL JOIN bowl USING (match_format, player_name))
      SELECT *, batting_points + bowling_points + fielding_points AS total_points,
        rank() OVER (PARTITION BY match_format ORDER BY batting_points + bowling_points + fielding_points DESC) AS rank
      FROM points QUALIFY rank <= 10"""),
    "X6_head_to_head_unordered": _pairs(
        "(SELECT least(team1, team2) AS team1, greatest(team1, team2) AS team2, winning_team, start_date FROM v_matches)"),
    "X7_form_of_last_ten": sql(f"""
      WITH {_RANKED}
      SELECT player_name, {mean('runs', 'rn <= 5')} AS last_5_avg, {mean('runs')} AS last_10_avg,
        {rate('strike_rate')} AS recent_sr, {_form(mean('runs'))} AS form_status
      FROM last_rows WHERE rn <= 10 GROUP BY player_id, player_name"""),
    "X8_quarterly_trajectory": sql(f"""
      WITH q AS (SELECT player_id, player_name, year(start_date) || '-Q' || quarter(start_date) AS quarter, count(*) AS matches,
          {mean('runs')} AS avg_runs, {rate('strike_rate')} AS avg_sr
        FROM {_B} WHERE start_date >= TIMESTAMP '{AS_OF}' - INTERVAL 2 YEAR AND balls >= 3
        GROUP BY player_id, player_name, year(start_date), quarter(start_date) HAVING count(*) >= 3),
      c AS (SELECT *, avg_runs - lag(avg_runs) OVER (PARTITION BY player_id ORDER BY quarter) AS change FROM q)
      SELECT player_name, quarter, matches, avg_runs, avg_sr, change,
        CASE WHEN change > 5 THEN 'Ascending' WHEN change < -5 THEN 'Declining' ELSE 'Stable' END AS trajectory FROM c"""),
}
