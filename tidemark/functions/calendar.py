"""Calendar vocabulary: frequencies, vague times, aliases, date expansion, rule-based request parsing (driver side), and column forms."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Filters

# --- fixed values ---
VAGUE_TIMES = {
    "early morning": ("07:00:00", 120),
    "morning": ("09:00:00", 180),
    "late morning": ("11:00:00", 120),
    "noon": ("12:00:00", 60),
    "afternoon": ("15:00:00", 180),
    "late afternoon": ("17:00:00", 120),
    "evening": ("19:00:00", 180),
    "late evening": ("21:00:00", 120),
    "night": ("22:00:00", 180),
    "midnight": ("00:00:00", 60),
    "early night": ("20:00:00", 120),
    "commute": ("08:30:00", 60),
}
REGION_ALIASES = {
    "nsw1": "NSW1",
    "nsw": "NSW1",
    "nsw.": "NSW1",
    "new south wales": "NSW1",
    "sydney": "NSW1",
    "qld1": "QLD1",
    "qld": "QLD1",
    "qld.": "QLD1",
    "queensland": "QLD1",
    "brisbane": "QLD1",
    "sa1": "SA1",
    "sa": "SA1",
    "s.a.": "SA1",
    "south australia": "SA1",
    "adelaide": "SA1",
    "vic1": "VIC1",
    "vic": "VIC1",
    "vic.": "VIC1",
    "victoria": "VIC1",
    "melbourne": "VIC1",
    "tas1": "TAS1",
    "tas": "TAS1",
    "tasmania": "TAS1",
    "hobart": "TAS1",
}
METRIC_ALIASES = {
    "rrp": "RRP",
    "price": "RRP",
    "$/mwh": "RRP",
    "spot price": "RRP",
    "wholesale price": "RRP",
    "totaldemand": "TOTALDEMAND",
    "demand": "TOTALDEMAND",
    "load": "TOTALDEMAND",
    "mw": "TOTALDEMAND",
}
METRICS = ("RRP", "TOTALDEMAND")
HOLIDAY_HINTS = ("holiday", "public holiday", "christmas", "new year", "boxing day", "easter", "good friday", "labor day", "anzac")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SECTORS = ("Retail", "Finance", "Healthcare", "Manufacturing", "Nature", "Energy", "Transportation")
# --- end of fixed values ---
SECTOR_WORDS = {"Energy": "electricity energy power demand load price mwh mw grid rrp", "Retail": "sales store retail shop customer", "Finance": "stock bond bank finance market loan", "Healthcare": "patient hospital health clinic", "Manufacturing": "factory production machine plant", "Nature": "rain temperature weather river climate", "Transportation": "traffic train flight bus freight road"}
_UNITS = {"m": "min", "min": "min", "mins": "min", "minute": "min", "minutes": "min", "h": "H", "hr": "H", "hrs": "H", "hour": "H", "hours": "H", "d": "D", "day": "D", "days": "D"}
_WORDS = {"hourly": "1H", "per hour": "1H", "daily": "1D", "per day": "1D", "quarter hour": "15min", "quarter-hour": "15min", "half hour": "30min", "half-hour": "30min", "5": "5min", "15": "15min", "20": "20min", "30": "30min"}


def normalise_freq(raw: str | None) -> str | None:
    """X1: '30 minutes', 'half hour', 'hourly', '2 days' -> 30min, 30min, 1H, 2D; unknown ones as they are."""
    if not raw:
        return None
    s = str(raw).strip().lower()
    if s in _WORDS:
        return _WORDS[s]
    m = re.fullmatch(r"(\d*)\s*([a-z]+)", s)
    if m and m[2] in _UNITS and (m[1] or m[2] in ("h", "hour", "hrs", "d", "day")):
        return f"{int(m[1] or 1)}{_UNITS[m[2]]}"
    return raw


def freq_column(c: Column) -> Column:
    """X1 over a column."""
    s = F.lower(F.trim(c))
    number, unit = F.regexp_extract(s, r"^(\d*)\s*([a-z]+)$", 1), F.regexp_extract(s, r"^(\d*)\s*([a-z]+)$", 2)
    n = F.when(number == "", F.lit("1")).otherwise(F.regexp_replace(number, r"^0+(?=\d)", ""))
    words = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    usable = units[unit].isNotNull() & ((number != "") | unit.isin("h", "hour", "hrs", "d", "day"))
    return F.coalesce(words[s], F.when(usable, F.concat(n, units[unit])), c)


def iso_date(value: str | None) -> date | None:
    """The date, or None if it isn't one."""
    try:
        return date.fromisoformat(str(value)[:10]) if value else None
    except ValueError:
        return None


def iso_datetime(value: str | datetime | None) -> datetime | None:
    """X2, X35."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    try:
        return datetime.fromisoformat(str(value).strip().replace("/", "-")).replace(tzinfo=None) if value else None
    except ValueError:
        return None


def day_bounds(d: date) -> tuple[datetime, datetime]:
    """X3."""
    return datetime.combine(d, time()), datetime.combine(d, time(23, 59, 59))


def vague_time(label: str | None) -> tuple[str, int] | None:
    """Centre and tolerance in minutes."""
    return VAGUE_TIMES.get((label or "").strip().lower())


def times_of(values) -> list[tuple[int, int, int]]:
    """HH:MM[:SS] as numbers; others are dropped."""
    out = []
    for v in values or ():
        m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", str(v).strip())
        if m and int(m[1]) < 24 and int(m[2]) < 60 and int(m[3] or 0) < 60:
            out.append((int(m[1]), int(m[2]), int(m[3] or 0)))
    return out


def as_list(value) -> list:
    """X5."""
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]


def as_bool(value) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "y")


def as_ints(value) -> tuple[int, ...]:
    return tuple(dict.fromkeys(int(x) for x in as_list(value) if re.fullmatch(r"\s*-?\d+\s*", str(x))))


def _aliases(values, aliases: dict[str, str], allowed=None) -> list[str]:
    named = (aliases.get(str(v).strip().lower(), str(v).strip().upper()) for v in as_list(values) if str(v).strip())
    return [v for v in dict.fromkeys(named) if allowed is None or v in allowed]


def regions_of(values) -> list[str]:
    """X12, O5."""
    return _aliases(values, REGION_ALIASES)


def metrics_of(values) -> list[str]:
    return _aliases(values, METRIC_ALIASES, METRICS)


def alias_column(c: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(c))], F.upper(F.trim(c)))


def salvage_json(text: str | None, keep: int | None = None) -> dict | None:
    """The object between the first brace and the last; else {'text': first keep characters} if keep is given."""
    a, b = (text or "").find("{"), (text or "").rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        found = None
    if isinstance(found, dict):
        return found
    return {"text": (text or "")[:keep]} if keep else None


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """A small JSON-schema check (type, required, properties, items, enum)."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    wanted = as_list(schema.get("type"))
    if wanted and not any(isinstance(value, kinds[k]) and not (k in ("integer", "number") and isinstance(value, bool)) for k in wanted):
        return [f"{path}: expected {'/'.join(wanted)}"]
    out = [f"{path}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, sub in schema.get("properties", {}).items():
            if k in value:
                out += schema_errors(value[k], sub, f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{path}[{k}]")
    return out


def filters_of(payload: dict, compat: bool = False) -> Filters:
    """A loose payload as Filters. An explicit time inside date_start is honoured."""
    text = lambda k: str(payload[k]) if payload.get(k) else None
    words = lambda k: tuple(dict.fromkeys(str(x) for x in as_list(payload.get(k)) if x not in (None, "")))
    times = tuple("%02d:%02d:%02d" % t for t in times_of(as_list(payload.get("times"))))
    vague = vague_time(payload.get("vague_label"))
    start, end = text("date_start") or text("start"), text("date_end") or text("end")
    at = iso_datetime(start)
    if not compat and at and at.time() != time() and not times:
        times = (at.strftime("%H:%M:%S"),)
    if vague and not times:
        times = (vague[0],)
    horizon = payload.get("horizon") or {}
    return Filters(groups=tuple(regions_of(payload.get("regions"))), metrics=tuple(metrics_of(payload.get("metrics"))), years=as_ints(payload.get("years")), months=as_ints(payload.get("months")), days=as_ints(payload.get("days")), times=times, date_start=start, date_end=end, start_time=text("start_time"), end_time=text("end_time"), freq=normalise_freq(payload.get("freq")), weekdays=words("weekdays"), weekends=as_bool(payload.get("weekends", False)), holidays=as_bool(payload.get("holidays", False)), horizon_steps=horizon.get("steps"), horizon_units=horizon.get("units"), single_timestamps=words("single_timestamps"), date_ranges=tuple(tuple(r) if not isinstance(r, dict) else (r.get("start"), r.get("end")) for r in as_list(payload.get("date_ranges"))), vague_label=text("vague_label"), vague_tolerance_minutes=payload.get("vague_tolerance_minutes") or (vague[1] if vague else None), period_type=text("period_type"), notes=merge_notes(text("notes"), text("period_type")))


def merge_notes(notes: str | None, period_type: str | None) -> str | None:
    """X13."""
    return " | ".join(x for x in (notes, f"PERIODTYPE={period_type}" if period_type else None) if x) or None


def concrete_dates(f: Filters, limit: int = 366) -> list[date]:
    """Every date that the filters name; impossible ones are skipped. Ranges are taken whole; of years x months x days the first limit combinations."""
    found: set[date] = set()
    for a, b in [*f.date_ranges, (f.date_start, f.date_end or f.date_start)]:
        lo, hi = iso_date(a), iso_date(b)
        if lo and hi:
            found |= {lo + timedelta(days=k) for k in range((hi - lo).days + 1)}
    found |= {d for s in f.single_timestamps if (d := iso_date(s))}
    for y, m, d in list(product(f.years, f.months, f.days))[:limit]:
        try:
            found.add(date(y, m, d))
        except ValueError:
            pass
    return sorted(found)


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (Meeus)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def is_holiday(d: date) -> bool:
    """X11: national public holidays of Australia, by their rules: fixed days, with the Monday after where New Year's Day and Australia Day fall on a weekend
    and the next free days for Christmas and Boxing Day; Good Friday and Easter Monday."""
    monday = lambda x: x + timedelta(days=(7 - x.weekday()) % 7) if x.weekday() >= 5 else x
    y, e = d.year, easter(d.year)
    christmas, boxing = date(y, 12, 25), date(y, 12, 26)
    shifted = [date(y, 12, 27)] * (christmas.weekday() in (5, 6)) + [date(y, 12, 28)] * (boxing.weekday() in (5, 6))
    return d in {date(y, 1, 1), monday(date(y, 1, 1)), date(y, 1, 26), monday(date(y, 1, 26)), e - timedelta(days=2), e + timedelta(days=1), date(y, 4, 25), christmas, boxing, *shifted}


def holiday_column(d: Column) -> Column:
    """X11 as an expression: is_holiday of a date column."""
    y, m, day, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)
    by = lambda x, n: F.floor(x / n).cast("int")
    a, b, c = y % 19, by(y, 100), y % 100
    h = (19 * a + b - by(b, 4) - by(b - by(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * by(c, 4) - h - c % 4) % 7
    n = h + k - 7 * by(a + 11 * h + 22 * k, 451) + 114
    since = F.datediff(d, F.make_date(y, by(n, 31), n % 31 + 1))  # days after Easter Sunday
    fixed = ((m == 1) & day.isin(1, 26)) | ((m == 4) & (day == 25)) | ((m == 12) & day.isin(25, 26))
    shifted = ((m == 1) & (wd == 0) & day.isin(2, 3, 27, 28)) | ((m == 12) & (wd < 2) & day.isin(27, 28))
    return fixed | shifted | since.isin(-2, 1)


def enrich(f: Filters, holiday=is_holiday) -> Filters:
    """Calendar components, weekend and holiday flags of the concrete dates. holiday: date -> bool."""
    dates = concrete_dates(f)
    named = any(h in (f.notes or "").lower() for h in HOLIDAY_HINTS)
    if not dates:
        return replace(f, holidays=f.holidays or named)
    merge = lambda own, new: tuple(sorted({*own, *new}))
    return replace(f, years=merge(f.years, (d.year for d in dates)), months=merge(f.months, (d.month for d in dates)), days=merge(f.days, (d.day for d in dates)), weekdays=tuple(w for k, w in enumerate(WEEKDAYS) if any(d.weekday() == k for d in dates)), weekends=any(d.weekday() >= 5 for d in dates), holidays=f.holidays or named or bool(holiday and any(map(holiday, dates))))


def date_columns(d: Column) -> list[Column]:
    """Calendar components of a day."""
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("dom"), F.weekday(d).alias("weekday"), (F.weekday(d) >= 5).alias("weekend"), F.weekofyear(d).alias("iso_week")]


def date_table(spark: SparkSession, start: str, end: str) -> DataFrame:
    """X9, X10 as a table: a row for each day with its calendar components."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.select("day", *date_columns(F.col("day")))


_MONTHS = {m.lower(): k for k, m in enumerate("January February March April May June July August September October November December".split(), 1)}

#: Vague times as whole words, longer ones first; aliases as whole words.
_VAGUE = [(v, re.compile(rf"\b{v}\b")) for v in sorted(VAGUE_TIMES, key=len, reverse=True)]
_ALIAS = {a: re.compile(rf"(?<![a-z]){re.escape(a)}(?![a-z])") for a in (*REGION_ALIASES, *METRIC_ALIASES)}
_NAMED_DAY = re.compile(rf"({'|'.join(_MONTHS)}) (\d{{1,2}}),? (\d{{4}})")


def parse_request(text: str, reference: datetime | None = None) -> Filters:
    """M9, M10 without a model: dates, times, regions, metrics and vague labels by rules."""
    low = text.lower()
    stamps = re.findall(r"\d{4}[-/]\d{2}[-/]\d{2}(?:[ t]\d{2}:\d{2}(?::\d{2})?)?", low)
    for m in _NAMED_DAY.finditer(low):
        stamps.append(f"{m[3]}-{_MONTHS[m[1]]:02d}-{int(m[2]):02d}")
    vague = next((v for v, whole in _VAGUE if v in low and whole.search(low)), None)
    horizon = re.search(r"next (\d+) (minute|hour|day|week|month)s?", low)
    has = lambda a: a in low and _ALIAS[a].search(low)
    return enrich(filters_of({"date_start": stamps[0] if stamps else None, "date_end": stamps[-1] if len(stamps) > 1 else None, "times": re.findall(r"(?<![\d-])\d{1,2}:\d{2}(?::\d{2})?", low), "regions": [a for a in REGION_ALIASES if len(a) > 2 and has(a)], "metrics": [a for a in METRIC_ALIASES if has(a)], "vague_label": vague, "horizon": {"steps": int(horizon[1]), "units": horizon[2]} if horizon else None, "freq": next((w for w in ("hourly", "daily", "half hour", "half-hour") if w in low), None), "notes": text if any(h in low for h in HOLIDAY_HINTS) else None}))


def route_of(target: datetime | date | None, reference: datetime) -> str:
    """M8: up to 15 days short, up to 365 mid, else long; mid where the target is unknown."""
    if target is None:
        return "mid_term"
    days = ((target if isinstance(target, datetime) else datetime.combine(target, time())) - reference).total_seconds() / 86400
    return "short_term" if days <= 15 else "mid_term" if days <= 365 else "long_term"


def route_column(target: Column, reference: Column) -> Column:
    days = (F.unix_micros(target.cast("timestamp")) - F.unix_micros(reference.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(target.isNull(), "mid_term").when(days <= 15, "short_term").when(days <= 365, "mid_term").otherwise("long_term")


def sector_of(text: str) -> str:
    """M7 by rules."""
    words = re.findall(r"[a-z]+", text.lower())
    hits = {s: sum(w in SECTOR_WORDS[s].split() for w in words) for s in SECTORS}
    best = max(SECTORS, key=lambda s: hits[s])
    return best if hits[best] else "Undetected"


def infer_columns(df: DataFrame, id_col: str = "id", text_col: str = "text", region_col: str | None = None, hint_col: str | None = None) -> DataFrame:
    """Metrics, region and horizon of evaluation queries."""
    text = F.upper(F.coalesce(F.col(text_col), F.lit("")))
    found = F.filter(F.array(*[F.when(text.contains(m), F.lit(m)) for m in ("TOTALDEMAND", "RRP")]), lambda x: x.isNotNull())
    region = F.coalesce(*[F.when(text.contains(r), F.lit(r)) for r in ("NSW1", "VIC1", "QLD1", "SA1", "TAS1")], F.lit("NSW1"))
    by_id = F.coalesce(*[F.when(F.col(id_col).contains(w), F.lit(f"{w}_term")) for w in ("short", "mid", "long")], F.lit("short_term"))
    given = lambda c, other: other if c is None else F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    return df.withColumns({"metrics": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("TOTALDEMAND"))), "region_code": F.upper(given(region_col, region)), "horizon": given(hint_col, by_id)})


def localise(df: DataFrame, ts: str, transitions: DataFrame) -> DataFrame:
    """Wall-clock timestamps across daylight-saving changes. transitions: gap_lo, gap_hi, fold_lo, fold_hi (a row for each change; a few for each
    year). Ambiguous times become null, times in a gap move to its end."""
    gap = (F.col(ts) >= F.col("gap_lo")) & (F.col(ts) < F.col("gap_hi"))
    fold = (F.col(ts) >= F.col("fold_lo")) & (F.col(ts) < F.col("fold_hi"))
    t = df.join(F.broadcast(transitions), gap | fold, "left")
    return t.withColumn(ts, F.when(fold, None).when(gap, F.col("gap_hi")).otherwise(F.col(ts))).drop("gap_lo", "gap_hi", "fold_lo", "fold_hi")
