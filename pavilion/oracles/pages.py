from pavilion.oracles.live import PLAYER
from pavilion.oracles.views import big, half_up, mean, mean2, rate2, sql, stamp, total_of_rate

_BAT = f"""bat AS (
  SELECT player_name, {big('sum(runs)')} AS total_runs, count(*) AS innings_played, {mean2('runs')} AS avg_runs,
    {rate2('strike_rate')} AS avg_strike_rate, {big('sum(fours)')} AS total_fours, {big('sum(sixes)')} AS total_sixes,
    max(runs) AS highest_score
  FROM v_batting GROUP BY player_name)"""
_BOWL = f"""bowl AS (
  SELECT player_name, {big('sum(wickets)')} AS total_wickets, count(*) AS matches, {rate2('economy')} AS avg_economy,
    {total_of_rate('overs')} AS total_overs, {big('sum(maidens)')} AS total_maidens,
    {mean2('wickets')} AS avg_wickets_per_match
  FROM v_bowling WHERE wickets > 0 GROUP BY player_name)"""


def _board(cte: str, name: str, order: str, search: str = "", top: bool = False) -> str:
    hit = f"WHERE contains(lower(player_name), '{search.lower()}')" if search else ""
    if not top:
        src = f"SELECT * FROM {name} {hit} ORDER BY {order}, player_name LIMIT 20"
    else:
        src = f"SELECT * FROM (SELECT * FROM {name} ORDER BY {order}, player_name LIMIT 40) {hit} ORDER BY {order}, player_name LIMIT 20"
    return sql(f"WITH {cte} SELECT *, row_number() OVER (ORDER BY {order}, player_name) AS rank FROM ({src})")


def _bat_career(extra: str = "", source: str = "v_batting") -> str:
    keys = f"player_id, player_name{extra}"
    return f"""SELECT {keys}, {big('sum(runs)')} AS runs_scored, count(*) AS innings_played,
      CASE WHEN count(*) FILTER (dismissal <> 'not out') > 0
        THEN {half_up('sum(runs)', "count(*) FILTER (dismissal <> 'not out')")} END AS batting_average,
      {half_up('100 * sum(runs)', 'sum(balls)')} AS strike_rate
      FROM {source} GROUP BY {keys}"""


def _bowl_career(extra: str = "", source: str = "v_bowling") -> str:
    keys = f"player_id, player_name{extra}"
    return f"""SELECT {keys}, {big('sum(wickets)')} AS wickets_taken, count(DISTINCT match_id) AS matches_played,
      CASE WHEN sum(wickets) > 0 THEN {half_up('sum(runs_conceded)', 'sum(wickets)')} END AS bowling_average,
      {rate2('economy')} AS economy_rate
      FROM {source} GROUP BY {keys}"""


_BAT_FY = "(SELECT b.*, match_format, year(start_date) AS year FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id)"
_BOWL_FY = "(SELECT b.*, match_format, year(start_date) AS year FROM v_bowling b JOIN v_matches m ON b.match_id = m.match_id)"
_MATCH = f"""match_id, series_id, series_name, match_type, match_desc, match_format,
  {stamp('start_date')} AS start_date, {stamp('end_date')} AS end_date, state, venue_id, venue, margin, margin_type,
  victory_margin, toss_decision, team1, team2, team1_id, team2_id, winning_team, toss_winner, status"""

SQL = {
    "P1_player_list": sql("""
      SELECT player_id, external_player_id, player_name,
        coalesce(strftime(date_of_birth, '%Y-%m-%d'), 'N/A') AS date_of_birth, country, role,
        CASE WHEN meta IS NULL THEN 'N/A' ELSE 'Bat: ' || batting_style || ', Bowl: ' || bowling_style END AS playing_style,
        coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), 'N/A') AS created_at
      FROM v_players ORDER BY player_name, player_id LIMIT 200"""),
    "P2_batting_board": _board(_BAT, "bat", "total_runs DESC"),
    "P2_batting_board_by_average": _board(_BAT, "bat", "avg_runs DESC"),
    "P2_batting_board_by_strike_rate": _board(_BAT, "bat", "avg_strike_rate DESC"),
    "P2_batting_board_by_innings": _board(_BAT, "bat", "innings_played DESC"),
    "P2_batting_board_search": _board(_BAT, "bat", "total_runs DESC", "R#00000001"),
    "P2_batting_board_search_top": _board(_BAT, "bat", "total_runs DESC", "R#00000001", True),
    "P3_bowling_board": _board(_BOWL, "bowl", "total_wickets DESC"),
    "P3_bowling_board_by_economy": _board(_BOWL, "bowl", "avg_economy NULLS FIRST", "CUSTOMER#00000005"),
    "P3_bowling_board_by_matches": _board(_BOWL, "bowl", "matches DESC"),
    "P4_summary_counts": sql("""
      SELECT 'Total Players' AS metric, count(*) AS total FROM v_players
      UNION ALL SELECT 'Total Matches', count(*) FROM v_matches
      UNION ALL SELECT 'Batting Records', count(*) FROM v_batting
      UNION ALL SELECT 'Bowling Records', count(*) FROM v_bowling"""),
    "P5_top_batters": sql(f"""
      SELECT player_name, {big('sum(runs)')} AS total_runs FROM v_batting
      GROUP BY player_name ORDER BY total_runs DESC, player_name LIMIT 5"""),
    "P5_top_bowlers": sql(f"""
      SELECT player_name, {big('sum(wickets)')} AS total_wickets FROM v_bowling WHERE wickets > 0
      GROUP BY player_name ORDER BY total_wickets DESC, player_name LIMIT 5"""),
    "P6_recent_series": sql(f"""
      SELECT series_name, count(*) AS matches, {stamp('max(start_date)')} AS last_match FROM v_matches
      WHERE series_name IS NOT NULL GROUP BY series_name ORDER BY max(start_date) DESC, series_name LIMIT 10"""),
    "P7_batting_career": sql(_bat_career()),
    "P7_batting_career_board": sql(f"""
      WITH c AS ({_bat_career()}), top AS (
        SELECT * FROM c ORDER BY batting_average DESC NULLS LAST, player_name, player_id LIMIT 20)
      SELECT * EXCLUDE (player_id),
        row_number() OVER (ORDER BY batting_average DESC NULLS LAST, player_name, player_id) AS rank FROM top"""),
    "P8_bowling_career": sql(_bowl_career()),
    "P8_bowling_career_board": sql(f"""
      WITH c AS ({_bowl_career()}), top AS (
        SELECT * FROM c ORDER BY bowling_average NULLS LAST, player_name, player_id LIMIT 20)
      SELECT * EXCLUDE (player_id),
        row_number() OVER (ORDER BY bowling_average NULLS LAST, player_name, player_id) AS rank FROM top"""),
    "P9_batting_format_year": sql(f"""
      SELECT * EXCLUDE (player_id) FROM ({_bat_career(', match_format, year', _BAT_FY)})"""),
    "P9_bowling_format_year": sql(f"""
      SELECT * EXCLUDE (player_id) FROM ({_bowl_career(', match_format, year', _BOWL_FY)})"""),
        "P9_batting_in_format": sql(f"""
      WITH c AS ({_bat_career(', match_format, year', _BAT_FY)}), top AS (
        SELECT * FROM c WHERE match_format = '1-URGENT' AND year = 2000
        ORDER BY runs_scored DESC, player_name, player_id LIMIT 30)
      SELECT * EXCLUDE (player_id, year), row_number() OVER (ORDER BY runs_scored DESC, player_name, player_id) AS rank FROM top"""),
    "P9_bowling_in_format": sql(f"""
      WITH c AS ({_bowl_career(', match_format, year', _BOWL_FY)}), top AS (
        SELECT * FROM c WHERE match_format = '1-URGENT' AND year = 2000
        ORDER BY wickets_taken DESC, player_name, player_id LIMIT 30)
      SELECT * EXCLUDE (player_id, year), row_number() OVER (ORDER BY wickets_taken DESC, player_name, player_id) AS rank FROM top"""),
    "P11_most_innings": sql(f"""
      WITH top AS (SELECT player_name, count(*) AS innings_played, {mean('runs')} AS avg_runs FROM v_batting
        GROUP BY player_name ORDER BY innings_played DESC, player_name LIMIT 20)
      SELECT *, row_number() OVER (ORDER BY innings_played DESC, player_name) AS rank FROM top"""),
    "V1_category_filter": sql("""
      SELECT match_id, match_type, series_name, match_format FROM v_matches WHERE match_type ILIKE '%women%'"""),
    "V2_matches_by_series": sql("""
      SELECT match_id, series_name, match_desc, count(*) OVER (PARTITION BY series_name) AS series_matches,
        min(match_id) OVER (PARTITION BY series_name) AS first_seen FROM v_matches"""),
    "V3_match_summary": sql("""
      SELECT match_id, coalesce(series_name, 'N/A') AS series, coalesce(team1, 'N/A') AS team_1,
        coalesce(team2, 'N/A') AS team_2, coalesce(match_format, 'N/A') AS format,
        coalesce(status, 'N/A') AS status, coalesce(venue, 'N/A') AS venue FROM v_matches"""),
    "C1_matches_with_venue": sql(f"""
      SELECT match_id, match_desc, team1, team2, match_format, {stamp('start_date')} AS start_date, winning_team,
        m.venue_id, venue_name, city, country FROM v_matches m LEFT JOIN v_venues v ON m.venue_id = v.venue_id"""),
    "C2_venues_by_capacity": sql("SELECT * FROM v_venues ORDER BY capacity DESC, venue_id"),
    "C3_largest_players": sql("""
      SELECT player_name, total_runs FROM v_players ORDER BY total_runs DESC NULLS LAST, player_id LIMIT 5"""),
    "C3_largest_venues": sql("SELECT venue_name, capacity FROM v_venues ORDER BY capacity DESC, venue_id LIMIT 5"),
    "C4_player_by_key": sql(f"SELECT {PLAYER} FROM v_players WHERE player_id = 42"),
    "C5_players_by_runs": sql(f"SELECT {PLAYER} FROM v_players"),
    "C5_matches_by_start": sql(f"SELECT {_MATCH} FROM v_matches"),
}

SQL["P9_stored_batting_in_format"] = SQL["P9_batting_in_format"]
