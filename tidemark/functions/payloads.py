"""Tables of loose request objects (JSON as models write it) as typed columns: variants and expressions throughout, no Python in the plan.

A value may stand alone or in a list, numbers and flags may be texts, ranges may name their ends in several ways. What cannot be read as its type is left out:
a null or malformed text, one with a repeated key, and one without an object give an empty request, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import HOLIDAY_HINTS, METRIC_ALIASES, METRICS, REGION_ALIASES, VAGUE_TIMES, alias_column, freq_column, holiday_column, route_column

# --- fixed values ---
MODALITIES = ("univariate", "multivariate")
UNITS = ("hours", "days", "weeks", "months")
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
RANGE_ENDS = {"date": (("start_date", "start", "from", "date_start"), ("end_date", "end", "to", "date_end")), "timestamp": (("start_time", "start", "from", "timestamp_start"), ("end_time", "end", "to", "timestamp_end"))}
# --- end of fixed values ---


def request_object(text: Column) -> Column:
    """What lies between the first brace and the last, as a variant; null if that is no object."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, key: str) -> Column:
    """A single value as text; empty ones are null."""
    return F.nullif(F.trim(_at(v, f"$.{key}", "string")), F.lit(""))


def items(v: Column, key: str) -> Column:
    """A list as it is, another value as a list of one, null as none."""
    return F.coalesce(_at(v, f"$.{key}", "array<variant>"), F.array_compact(F.array(_at(v, f"$.{key}", "variant"))))


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.array_compact(values))


def texts(v: Column, key: str) -> Column:
    return _distinct(F.transform(items(v, key), lambda x: F.nullif(F.trim(_at(x, "$", "string")), F.lit(""))))


def _whole(s: Column) -> Column:
    """Texts of up to nine digits are numbers."""
    return F.when(s.rlike(r"^\s*-?[0-9]{1,9}\s*$"), F.trim(s).try_cast("int"))


def numbers(v: Column, key: str, lo: int | None = None, hi: int | None = None) -> Column:
    inside = lambda n: F.lit(True) if lo is None else n.between(lo, hi)
    return F.filter(_distinct(F.transform(texts(v, key), _whole)), inside)


def flag(v: Column, key: str) -> Column:
    """true, 1, yes and y in either case."""
    return F.coalesce(F.lower(_text(v, key)).isin("true", "1", "yes", "y"), F.lit(False))


def day_of(s: Column) -> Column:
    """The date that a text starts with."""
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(s, 1, 10).try_cast("date"))


def time_of(s: Column) -> Column:
    """A timestamp as its wall clock says, whatever its zone; a date is its midnight."""
    said = F.regexp_extract(s, r"(?i)^([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?)(?:Z|[+-][0-9]{2}:?[0-9]{2})?$", 1)
    return F.nullif(said, F.lit("")).try_cast("timestamp_ntz")


def clock_of(s: Column) -> Column:
    """H:MM[:SS] as HH:MM:SS."""
    return F.when(s.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), F.concat(F.lpad(F.split_part(s, F.lit(":"), F.lit(1)), 2, "0"), F.lit(":"), F.split_part(s, F.lit(":"), F.lit(2)), F.lit(":"), F.coalesce(F.nullif(F.split_part(s, F.lit(":"), F.lit(3)), F.lit("")), F.lit("00"))))


def _ranges(v: Column, key: str, ends: tuple, read) -> Column:
    """Objects with a start or an end, under the first name that holds one; others go."""
    end = lambda x, names: read(F.coalesce(*[_text(x, n) for n in names]))
    made = F.transform(items(v, key), lambda x: F.struct(end(x, ends[0]).alias("start"), end(x, ends[1]).alias("end")))
    return F.filter(made, lambda r: r["start"].isNotNull() | r["end"].isNotNull())


def _aliased(v: Column, key: str, aliases: dict[str, str]) -> Column:
    return _distinct(F.transform(texts(v, key), lambda s: alias_column(s, aliases)))


def fields(v: Column) -> dict[str, Column]:
    """The columns of a request from its variant. Weekdays are told by their first three letters."""
    vague = F.create_map(*[F.lit(x) for k, (at, tol) in VAGUE_TIMES.items() for x in (k, f"{at}/{tol}")])[F.lower(_text(v, "vague_label"))]
    weekday = lambda s: F.when(F.upper(s).rlike(f"^({'|'.join(DAYS)})([A-Z]*DAY)?$"), F.upper(F.substring(s, 1, 3)))
    first = F.get(items(v, "horizon"), F.lit(0))
    units = F.lower(_text(first, "units"))
    clocks = _distinct(F.transform(texts(v, "times"), clock_of))
    return {
        "groups": _aliased(v, "regions", REGION_ALIASES),
        "metrics": F.filter(_aliased(v, "metrics", METRIC_ALIASES), lambda m: m.isin(*METRICS)),
        "years": numbers(v, "years"),
        "months": numbers(v, "months", 1, 12),
        "days": numbers(v, "days", 1, 31),
        "times": F.when((F.size(clocks) == 0) & vague.isNotNull(), F.array(F.split_part(vague, F.lit("/"), F.lit(1)))).otherwise(clocks),
        "date_start": day_of(_text(v, "date_start")),
        "date_end": day_of(_text(v, "date_end")),
        "start_time": time_of(_text(v, "start_time")),
        "end_time": time_of(_text(v, "end_time")),
        "freq": freq_column(_text(v, "freq")),
        "weekdays": _distinct(F.transform(texts(v, "weekdays"), weekday)),
        "weekends": flag(v, "weekends"),
        "weekend_dates": _distinct(F.transform(texts(v, "weekend_dates"), day_of)),
        "holidays": flag(v, "holidays"),
        "holiday_dates": _distinct(F.transform(texts(v, "holiday_dates"), day_of)),
        "horizon_steps": _whole(_text(first, "steps")),
        "horizon_units": F.when(units.isin(*UNITS), units),
        "horizon_hint": F.coalesce(_text(first, "hint"), F.nullif(F.trim(F.when(F.schema_of_variant(first) == "STRING", _at(first, "$", "string"))), F.lit(""))),
        "modality": F.when(F.lower(_text(v, "modality")).isin(*MODALITIES), F.lower(_text(v, "modality"))),
        "single_timestamps": _distinct(F.transform(texts(v, "single_timestamps"), time_of)),
        "timestamp_ranges": _ranges(v, "timestamp_ranges", RANGE_ENDS["timestamp"], time_of),
        "date_ranges": _ranges(v, "date_ranges", RANGE_ENDS["date"], day_of),
        "vague_label": _text(v, "vague_label"),
        "vague_tolerance": F.coalesce(_whole(_text(v, "vague_tolerance_minutes")), F.split_part(vague, F.lit("/"), F.lit(2)).cast("int")),
        "notes": _text(v, "notes"),
    }


def targets() -> dict[str, Column]:
    """Start and end of what is asked for. Times win over dates; a single date is its whole day."""
    timed = F.col("start_time").isNotNull() | F.col("end_time").isNotNull()
    opens = lambda d: d.cast("timestamp_ntz")
    closes = lambda d: d.cast("timestamp_ntz") + F.expr("make_dt_interval(0, 23, 59, 59)")
    start, end = F.col("date_start"), F.col("date_end")
    return {"target_start": F.coalesce("start_time", opens(start), F.when(~timed, opens(end))), "target_end": F.coalesce("end_time", closes(end), F.when(~timed, closes(start)))}


def _days_between(a: Column, b: Column) -> Column:
    """Every day from a to b; where one is missing, the other; none if b lies before a."""
    lo, hi = F.coalesce(a, b), F.coalesce(b, a)
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>"))


def concrete_dates() -> Column:
    """Every date that a request names: target, spans, single times, and its years by its months by its days as far as they exist."""
    spans = lambda c: F.flatten(F.transform(c, lambda r: _days_between(r["start"].cast("date"), r["end"].cast("date"))))
    of = lambda y, m: F.transform("days", lambda d: F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))
    parts = F.flatten(F.flatten(F.transform("years", lambda y: F.transform("months", lambda m: of(y, m)))))
    single = F.transform("single_timestamps", lambda t: t.cast("date"))
    target = F.coalesce(_days_between(F.col("target_start").cast("date"), F.col("target_end").cast("date")), F.array().cast("array<date>"))
    return F.array_sort(_distinct(F.concat(target, spans(F.col("date_ranges")), spans(F.col("timestamp_ranges")), single, parts)))


def request_payloads(df: DataFrame, text: str) -> DataFrame:
    """X6 to X11 over a table: df with a struct `request`: the fields, target_start, target_end, and dates with what the calendar says of them. Years, months,
    days and weekdays hold those of the dates as well; weekend_dates and holiday_dates too, and the flags are set where there are any (holidays also where notes
    name one). The columns of df stay, but for one called request. A row holds every day of its spans."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), request_object(F.col(f"`{text}`")).alias("_v"))
    made = own.select("_row", *[c.alias(n) for n, c in fields(F.col("_v")).items()])
    made = made.withColumns(targets()).withColumn("dates", concrete_dates())
    weekend, holiday = F.filter("dates", lambda d: F.weekday(d) >= 5), F.filter("dates", holiday_column)
    named = F.coalesce(F.lower("notes").rlike("|".join(HOLIDAY_HINTS)), F.lit(False))
    merged = lambda c, new: F.array_sort(F.array_union(F.col(c), new))
    part = lambda f: F.transform("dates", f)
    names = F.array(*map(F.lit, DAYS))
    both = F.array_union("weekdays", part(lambda d: F.get(names, F.weekday(d))))
    made = made.withColumns({"weekend_dates": merged("weekend_dates", weekend), "holiday_dates": merged("holiday_dates", holiday)})
    made = made.withColumns({"years": merged("years", part(F.year)), "months": merged("months", part(F.month)), "days": merged("days", part(F.dayofmonth)), "weekdays": F.array_intersect(names, both), "weekends": F.col("weekends") | (F.size("weekend_dates") > 0), "holidays": F.col("holidays") | (F.size("holiday_dates") > 0) | named})
    return made.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != "request"], F.struct(*[c for c in made.columns if c != "_row"]).alias("request"))


def asked(requests: DataFrame, question_id: str, anchor: str | None = None, reference: Column | None = None) -> DataFrame:
    """Rows of request_payloads as a table of questions for operators.questions. The route is the hint where that names one, else told by how far
    target_start lies from the reference (the anchor, else now); anchor: a column with the time before which evidence lies (none: the latest reading)."""
    r = F.col("request")
    since = reference if reference is not None else F.coalesce(F.col(anchor).cast("timestamp_ntz"), F.localtimestamp()) if anchor else F.localtimestamp()
    hint = F.lower(r["horizon_hint"])
    route = F.coalesce(F.when(hint.isin("short_term", "mid_term", "long_term"), hint), route_column(r["target_start"].cast("timestamp"), since.cast("timestamp")))
    return requests.select(F.col(question_id).alias("question_id"), route.alias("route"), (F.col(anchor) if anchor else F.lit(None)).cast("timestamp_ntz").alias("anchor"), *[r[c].alias(c) for c in ("groups", "times", "target_start", "target_end", "freq")])
