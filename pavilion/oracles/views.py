"""Role views over the orders data set, as SQL, and text helpers for exact rounding."""

VIEWS = """
v_players AS (
  SELECT c_custkey AS player_id, CAST(c_custkey AS VARCHAR) AS external_player_id, c_name AS player_name,
    CASE WHEN c_custkey % 5 <> 0 THEN DATE '1980-01-01' + CAST(c_custkey % 9000 AS INTEGER) END AS date_of_birth,
    n_name AS country,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Batsman' WHEN 'MACHINERY' THEN 'Bowler'
      WHEN 'FURNITURE' THEN 'All-rounder' WHEN 'HOUSEHOLD' THEN 'Wicket-keeper' END AS role,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Right-hand bat' END AS batting_style,
    CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Legbreak' END AS bowling_style,
    CAST(round(c_acctbal) AS BIGINT) AS total_runs, c_custkey % 90 AS total_wickets,
    c_custkey % 60 + CAST(0.5 AS DOUBLE) AS batting_average, c_custkey % 45 + CAST(0.5 AS DOUBLE) AS bowling_average,
    CASE WHEN c_custkey % 7 <> 0 THEN '{"batting_style": "' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Right-hand bat' END
      || '", "bowling_style": "' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Legbreak' END || '"}' END AS meta,
    CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST(c_custkey % 100000 AS INTEGER)) END AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
v_venues AS (
  SELECT s_suppkey AS venue_id, s_name AS venue_name, n_name AS city, r_name AS country,
    CAST(floor(10000 + s_acctbal * 10) AS BIGINT) AS capacity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v_teams AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
    CAST(c_nationkey AS BIGINT) AS k1, (CAST(c_nationkey AS BIGINT) + 1 + o_orderkey % 24) % 25 AS k2,
    o_custkey % 40 AS s, o_custkey % 50 AS g, o_orderstatus IN ('F', 'O') AS decided,
    CASE WHEN o_orderkey % 2 = 0 THEN 'runs' ELSE 'wickets' END AS kind
  FROM orders JOIN customer ON o_custkey = c_custkey),
v_winner AS (
  SELECT *, 'NATION_' || k1 AS team1, 'NATION_' || k2 AS team2,
    CASE o_orderstatus WHEN 'F' THEN 'NATION_' || k1 WHEN 'O' THEN 'NATION_' || k2 END AS winning_team
  FROM v_teams),
v_matches AS (
  SELECT o_orderkey AS match_id, s AS series_id, 'Series ' || s AS series_name,
    CASE s % 4 WHEN 0 THEN 'International' WHEN 1 THEN 'League' WHEN 2 THEN 'Domestic' ELSE 'Women' END AS match_type,
    'Match ' || (o_orderkey % 500) AS match_desc, o_orderpriority AS match_format,
    o_orderdate AS start_date, CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) AS end_date,
    CASE WHEN decided THEN 'Complete' ELSE 'Preview' END AS state,
    (SELECT max(s_suppkey) FROM supplier) - g AS venue_id,
    CASE WHEN g = 7 THEN 'N/A' WHEN g <> 8 THEN 'Ground ' || g || ', City ' || (g % 10) || ', Land ' || (g % 4) END AS venue,
    CASE WHEN decided THEN o_orderkey % 80 + 1 END AS margin,
    CASE WHEN decided THEN kind END AS margin_type,
    CASE WHEN decided THEN (o_orderkey % 80 + 1) || ' ' || kind END AS victory_margin,
    CASE WHEN o_orderkey % 3 = 0 THEN 'bat' ELSE 'bowl' END AS toss_decision,
    team1, team2, k1 AS team1_id, k2 AS team2_id, winning_team,
    CASE WHEN o_custkey % 2 = 0 THEN team1 ELSE team2 END AS toss_winner,
    CASE WHEN winning_team IS NOT NULL THEN winning_team || ' won by ' || (o_orderkey % 80 + 1) || ' ' || kind
      WHEN o_orderkey % 30 = 29 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Match Tied'
      WHEN o_orderkey % 3 = 1 THEN 'Match abandoned due to rain'
      WHEN o_orderkey % 2 = 0 THEN 'No Result' ELSE 'Preview' END AS status
  FROM v_winner),
v_rows AS (
  SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem),
v_batting AS (
  SELECT l_orderkey AS match_id, l_orderkey || '-' || l_returnflag AS innings_id, l_suppkey AS player_id,
    c_name AS player_name, ln AS batting_position, 3 * q AS runs, 2 * q + ln AS balls, q % 11 AS fours, q % 6 AS sixes,
    CAST((20000 * 3 * q + 2 * q + ln) // (2 * (2 * q + ln)) AS DOUBLE) / 100 AS strike_rate,
    CASE WHEN l_linestatus = 'F' THEN 'out' ELSE 'not out' END AS dismissal, l_returnflag = 'A' AS first_side
  FROM v_rows JOIN customer ON c_custkey = l_suppkey),
v_bowling AS (
  SELECT l_orderkey AS match_id, l_orderkey || '-' || l_returnflag AS innings_id, c_custkey AS player_id,
    c_name AS player_name, CAST(q % 11 AS DOUBLE) AS overs, ln % 3 AS maidens,
    CAST(floor(l_extendedprice) AS BIGINT) % 70 AS runs_conceded, q % 7 AS wickets,
    floor(l_tax * 10000 + 0.5) / 100 AS economy
  FROM v_rows JOIN customer ON c_custkey = l_partkey % 120 + 20),
v_innings AS (
  SELECT b.match_id, innings_id, sum(runs) AS runs, count(*) FILTER (dismissal = 'out') AS wickets,
    floor(sum(balls) / 6) + CAST(sum(balls) % 6 AS DOUBLE) / 10 AS overs,
    CASE WHEN bool_or(first_side) THEN min(team1) ELSE min(team2) END AS batting_team,
    CASE WHEN bool_or(first_side) THEN min(team2) ELSE min(team1) END AS bowling_team
  FROM v_batting b JOIN v_matches m ON b.match_id = m.match_id GROUP BY b.match_id, innings_id)
"""

AS_OF = "2001-08-01"


def sql(body: str) -> str:
    """A statement over the role views; the body may start with further CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {VIEWS}, {body[5:]}"
    return f"WITH {VIEWS}\n{body}"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def half_up(num: str, den: str, digits: int = 2) -> str:
    """num / den rounded half up, integers only."""
    shift = 10**digits
    return f"(CAST(({2 * shift} * ({num}) + ({den})) // (2 * ({den})) AS DOUBLE) / {shift})"


def mean(col: str, cond: str = "") -> str:
    keep = f" FILTER ({cond})" if cond else ""
    return f"(CAST(sum({col}){keep} AS DOUBLE) / nullif(count({col}){keep}, 0))"


def fixed(col: str) -> str:
    return f"CAST(floor({col} * 100000000 + 0.5) AS BIGINT)"


def rate(col: str, cond: str = "") -> str:
    """Mean of a rate by exact sums in whole units of eight decimals."""
    keep = f" FILTER ({cond})" if cond else ""
    return f"(CAST(sum({fixed(col)}){keep} AS DOUBLE) / CAST(count({col}){keep} * 100000000 AS DOUBLE))"


def rate2(col: str) -> str:
    return half_up(f"sum({fixed(col)})", f"count({col}) * 100000000")


def mean2(col: str) -> str:
    return half_up(f"sum({col})", f"count({col})")


def total_of_rate(col: str) -> str:
    return f"(CAST(sum({fixed(col)}) AS DOUBLE) / 100000000)"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"
