"""Value-level parsing and labelling, as Column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

NA = "N/A"

# Alias keys a feed may use, in order of preference.
TEAM_NAME_KEYS = ("teamName", "teamname", "teamSName", "teamSname", "name", "shortName", "displayName")
TEAM_NESTED_KEYS = ("team", "teamInfo")
TEAM_ID_KEYS = ("teamId", "id", "team_id", "externalId", "external_team_id")
# Texts that count as "no style given".
NO_STYLE = ("", "none", "n/a")


def filled(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(c), F.lit(""))


def safe_int(c: Column) -> Column:
    """Long, NULL for blank or bad text; "45.0" counts as 45."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "").try_cast("bigint")


def safe_float(c: Column) -> Column:
    """Double, NULL for blank, bad or non-finite text."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def overs_value(c: Column) -> Column:
    """Overs text to the decimal form 4.3 (4 overs, 3 balls); 0.0 for blank or bad text."""
    text = F.trim(c.cast("string"))
    part = F.split(text, r"\.")
    balls = F.get(part, F.lit(1)).try_cast("int").cast("string")
    joined = F.concat(F.get(part, F.lit(0)).try_cast("int").cast("string"), F.lit("."), balls)
    return F.coalesce(F.when(text.contains("."), joined).otherwise(text).try_cast("double"), F.lit(0.0))


def balls_in(overs: Column) -> Column:
    """Ball count of a decimal overs value."""
    whole = F.floor(overs)
    return (whole * 6 + F.floor((overs - whole) * 10 + F.lit(0.5))).cast("long")


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds (number or numeric text) to a UTC wall-clock timestamp.

    Other text is read as a timestamp; blank gives NULL. The result has no zone,
    so it does not move with the session time zone.
    """
    text = filled(c.cast("string"))
    millis = text.try_cast("double").try_cast("bigint")
    return F.coalesce(_from_millis(millis), text.try_cast("timestamp_ntz"))


# First and last millisecond of the years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def _from_millis(ms: Column) -> Column:
    ms = F.when(ms.between(FIRST_MS, LAST_MS), ms)
    days = F.floor(ms / F.lit(86_400_000))
    rest = (ms - days * F.lit(86_400_000)).cast("double") / F.lit(1000)
    start = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def to_epoch_ms(ts: Column) -> Column:
    """UTC wall-clock timestamp to epoch milliseconds, whole days from the date part."""
    day = F.to_date(ts)
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") + F.floor(F.second(ts)).cast("long")
    return days * F.lit(86_400_000) + seconds * F.lit(1000)


JSON_MAP = "map<string,string>"


def object_map(text: Column) -> Column:
    """JSON object text as a map of its fields' texts; NULL for anything else."""
    return F.from_json(F.when(text.startswith("{"), text), JSON_MAP)


def _first_key(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[filled(fields[k]) for k in keys])


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, also inside the lambda of another function."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _items(text: Column) -> Column:
    return F.from_json(F.when(text.startswith("["), text), "array<string>")


_WALK = "struct<name: string, todo: array<string>>"


def _look(state: Column) -> Column:
    """The walk one value further: the first text to do is a name, or gives way to what lies in it, in order."""
    head, rest = F.get(state["todo"], F.lit(0)), F.slice(state["todo"], 2, F.greatest(F.size(state["todo"]) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    known = lambda texts: F.filter(texts, lambda x: x.isNotNull())

    def step(read: Column) -> Column:
        fields, items = read["fields"], read["items"]
        nested = F.array(*[F.when(filled(fields[k]).startswith("{"), filled(fields[k])) for k in TEAM_NESTED_KEYS])
        name = F.when(fields.isNotNull(), _first_key(fields, TEAM_NAME_KEYS)).when(items.isNull(), read["text"])
        below = F.when(fields.isNotNull(), known(nested)).when(items.isNotNull(), known(F.transform(items, filled))).otherwise(none)
        return F.struct(name.alias("name"), F.concat(below, rest).alias("todo")).cast(_WALK)

    read = F.struct(head.alias("text"), object_map(head).alias("fields"), _items(head).alias("items"))
    return F.when(state["name"].isNotNull() | (F.size(state["todo"]) == 0), state).otherwise(bound(read, step))


def _name_inside(text: Column) -> Column:
    """Name in the text of an object or list: of an object, of the first item of a list that has one, however deep.

    Each step takes one value, and a text holds no more values than brackets, braces and commas.
    """
    values = F.length(F.regexp_replace(text, r"[^\[{,]", "")) + 1
    start = F.struct(F.lit(None).cast("string").alias("name"), F.array(text).alias("todo")).cast(_WALK)
    return F.aggregate(F.sequence(F.lit(1), values), start, lambda state, _: _look(state))["name"]


def team_name(c: Column, fields: Column | None = None) -> Column:
    """Team name from plain text, or from the JSON text of objects and lists, nested to any depth.

    Text that only looks like JSON is returned as it is. ``fields`` may hold
    ``object_map(c)`` when the caller already has it.
    """
    text = filled(c)
    fields = object_map(text) if fields is None else fields
    plain = F.when(~text.rlike(r"^[\[{]"), text)
    # Most names lie in the object itself or in the first one below it; only others need the walk.
    below = F.coalesce(*[F.when(filled(fields[k]).startswith("{"), filled(fields[k])) for k in TEAM_NESTED_KEYS])
    shallow = _first_key(object_map(below), TEAM_NAME_KEYS)
    return F.coalesce(plain, _first_key(fields, TEAM_NAME_KEYS), shallow, F.when(text.isNotNull(), _name_inside(text)))


def team_id(c: Column, fields: Column | None = None) -> Column:
    """Team id from the JSON text of an object; a scalar, a list or an object without an id as its text."""
    text = filled(c)
    fields = object_map(text) if fields is None else fields
    return F.coalesce(F.coalesce(*[fields[k] for k in TEAM_ID_KEYS]), text)


def split_venue(c: Column) -> Column:
    """Struct of venue_name, city, country from comma text; the name is the last part."""
    part = F.split(c, ",")
    pick = lambda i: F.coalesce(F.trim(F.get(part, F.lit(i))), F.lit(""))
    return F.struct(
        F.trim(F.substring_index(c, ",", -1)).alias("venue_name"),
        pick(1).alias("city"),
        pick(2).alias("country"),
    )


def playing_style(meta: Column) -> Column:
    """"Bat: x, Bowl: y" from player meta JSON, N/A for missing keys, N/A alone for bad or empty JSON."""
    style = lambda key: F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit(NA))
    text = F.concat(F.lit("Bat: "), style("batting_style"), F.lit(", Bowl: "), style("bowling_style"))
    return F.when(F.get_json_object(filled(meta), "$").isNotNull(), text).otherwise(F.lit(NA))


def derive_role(meta: Column) -> Column:
    """Playing role from the two styles in player meta JSON."""
    bat = F.lower(F.coalesce(F.get_json_object(meta, "$.batting_style"), F.lit("")))
    bowl = F.lower(F.coalesce(F.get_json_object(meta, "$.bowling_style"), F.lit("")))
    has = lambda c: ~F.trim(c).isin(*NO_STYLE)
    return (
        F.when(bat.contains("wicket") | bowl.contains("wicket"), "Wicket-keeper")
        .when(has(bat) & has(bowl), "All-rounder")
        .when(has(bat), "Batsman")
        .when(has(bowl), "Bowler")
        .otherwise("Batsman")
    )


def from_year(ts: Column, first: int, last: int | None = None) -> Column:
    """The time lies in the years from first (to last), as a range a scan can skip files by."""
    start = lambda year: F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")
    since = ts >= start(first)
    return since if last is None else since & (ts < start(last + 1))


def or_na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NA))


def starts_and_won(status: Column, team: Column) -> Column:
    """Status text begins with the team and says "won" after it, letter case ignored."""
    s, t = F.lower(status), F.lower(team)
    return F.startswith(s, t) & (F.instr(F.substr(s, F.length(t) + 1), "won") > 0)
