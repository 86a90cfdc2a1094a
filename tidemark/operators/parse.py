"""Forecast texts to rows (metric, value, ts): Markdown tables first, then sentences."""

from __future__ import annotations

import re
from datetime import datetime
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import METRIC_ALIASES

ROW = "array<struct<metric:string,value:double,ts:timestamp_ntz>>"
_MONTHS = "January February March April May June July August September October November December".split()
_NUMBER = r"[-+]?\$?\d[\d,]*(?:\.\d+)?"
_number = re.compile(_NUMBER)
_STAMP = re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[ T]+(?:at )?(\d{1,2}):(\d{2})(?::(\d{2}))?")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in _MONTHS)
_CLOCK = r"(?:,?\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?"
_NAMED = re.compile(rf"\b(?=[JFMASOND])({_MONTH})\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_CLOCK}", re.I)
_DAY_FIRST = re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\b\.?,?\s+(\d{{4}}){_CLOCK}", re.I)
_MONTH_NUMBER = {m[:3].lower(): k for k, m in enumerate(_MONTHS, 1)}
_has_year = re.compile(r"\d{4}").search
#: Words before a value that say it is no forecast, unless one of the words after them is nearer.
_NO_FORECAST = "average|mean|median|range|observed|historical|historically|prior|previous|evidence|window|between|error|confidence|±|was|were"
_FORECAST = "forecast|predict|predicted|prediction|expect|expected|estimate|estimated|projected|will be"


def stamp(text: str) -> datetime | None:
    """P5: numeric or named month (whole or three letters, before or after the day), 24 hours or AM/PM."""
    if not _has_year(text):
        return None
    m = _STAMP.search(text) or _NAMED.search(text) or _DAY_FIRST.search(text)
    return _moment(m) if m else None


def _moment(m: re.Match) -> datetime | None:
    """The time that a match of one of the three patterns says."""
    if m.re is _STAMP:
        parts = [int(x or 0) for x in m.groups()]
    else:
        month, day = (m[1], m[2]) if m.re is _NAMED else (m[2], m[1])
        hour = int(m[4] or 0)
        if m[7]:
            hour = hour % 12 + 12 * (m[7].lower() == "pm")
        parts = [int(m[3]), _MONTH_NUMBER[month[:3].lower()], int(day), hour, int(m[5] or 0), int(m[6] or 0)]
    try:
        return datetime(*parts)
    except ValueError:
        return None


def number(text: str) -> float | None:
    """P6."""
    m = _number.search(text.replace("~", "").replace("≈", ""))
    return float(m[0].replace(",", "").replace("$", "")) if m else None


def unit_of(text: str) -> str | None:
    """The metric that a unit means; $/MWh is a price, GW and MW demand."""
    low = text.lower().replace(" ", "")
    return "RRP" if "mwh" in low else "TOTALDEMAND" if "mw" in low or "gw" in low else None


_ALIASES = [(a, m, re.compile(rf"(?<![a-z]){re.escape(a)}(?![a-z])")) for a, m in sorted(METRIC_ALIASES.items(), key=lambda x: -len(x[0]))]


def _metric(header: str) -> str | None:
    low = re.sub(r"[*_`]", "", header).lower()
    return next((m for a, m, whole in _ALIASES if a in low and whole.search(low)), None)


def clean(text: str) -> str:
    """Markdown emphasis removed, rows that run on behind a title put on lines of their own, reasons after the forecast cut off."""
    body = re.sub(r"\*\*|__|`", "", text)
    body = re.sub(r"(?i)(#+\s*forecast[^|\n]*?)\s*\|", r"\1\n|", body)
    heads = list(re.finditer(r"(?im)^\s*#*\s*(?:rationale|reasoning|explanation|justification)\b", body))
    return body[: heads[0].start()] if heads and heads[0].start() > 0 else body


def section(body: str) -> str:
    """The parts under titles that speak of a forecast, if there are any with a number in them; else the whole text."""
    heads = list(re.finditer(r"(?m)^\s*#{1,6}\s+(.+)$", body))
    ends = [*(h.start() for h in heads[1:]), len(body)]
    own = [body[h.start() : e] for h, e in zip(heads, ends) if "forecast" in h[1].lower()]
    own = [x for x in own if re.search(r"\d", x.partition("\n")[2])]
    # a forecast may also be given in a sentence elsewhere
    return "\n\n".join(own) if own and not re.search(r"(?i)\bforecast\s*:|\bi\s+forecast\b", body) else body


def tables(text: str) -> list[tuple[str, float, datetime]]:
    """Rows of Markdown tables. A column is a metric by its header or by its unit cell; an empty time cell repeats the one above."""
    out, header, last = [], [], None
    for line in text.splitlines():
        if line.count("|") < 2:
            header, last = [], None
            continue
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
            continue
        at = next((t for c in cells if (t := stamp(c))), None)
        if at is None and not (header and last and any(number(c) is not None for c in cells)):
            header = cells
            continue
        at = last = at or last
        unit = next((u for c in cells if not re.search(r"\d", c) and (u := unit_of(c))), None)
        both = next((c for c in cells if not re.search(r"\d", c) and "mwh" in c.lower() and re.search(r"mw(?!h)", c.lower())), None)
        values = [(k, number(c)) for k, c in enumerate(cells) if stamp(c) is None and re.search(r"\d", c) and number(c) is not None]
        if both and len(values) == 2:
            out += [("TOTALDEMAND", values[0][1], at), ("RRP", values[1][1], at)]
            continue
        for k, v in values:
            name = (_metric(header[k]) if k < len(header) else None) or unit_of(cells[k]) or unit
            if name:
                out.append((name, v * (1000 if "gw" in (cells[k] + (header[k] if k < len(header) else "")).lower() else 1), at))
    return out


_telling = re.compile(rf"(?i)(?<![a-z])(?:{_NO_FORECAST}|{_FORECAST})(?![a-z])")
_NO_WORDS = set(_NO_FORECAST.split("|"))


def _is_no_forecast(before: str) -> bool:
    """Whether the last of the telling words before a value says that it is no forecast."""
    said = _telling.findall(before)
    return bool(said) and said[-1].lower() in _NO_WORDS


def times_in(text: str) -> list[tuple[int, int, datetime]]:
    """(start, end, time) of every time in a text, in order; none overlap."""
    found = sorted((m.start(), m.end(), at) for pattern in (_STAMP, _NAMED, _DAY_FIRST) for m in pattern.finditer(text) if (at := _moment(m))) if _has_year(text) else []
    out: list[tuple[int, int, datetime]] = []
    for lo, hi, at in found:
        if not out or lo >= out[-1][1]:
            out.append((lo, hi, at))
    return out


_digit = re.compile(r"\d").search
_stop = re.compile(r"[.;!?]\s")
_VALUE = re.compile(rf"(?=[TRDPL+\-$\d])(?:(TOTALDEMAND|RRP|demand|price|load)\b[^\d$=:.;]{{0,30}}[=:]?\s*[~≈]?\s*)?({_NUMBER})\s*(\$?/?\s*(?:MWh|MW|GW)\b|/MWh)?", re.I)


def values_in(line: str) -> list[tuple[int, str, float]]:
    """(place, metric, value) of the values with a unit or a metric's name before them. Those whose sentence says that they are averages, ranges, observations or
    history are left out."""
    out = []
    if not _digit(line):
        return out
    for m in _VALUE.finditer(line):
        name = ("RRP" if m[2].startswith("$") and m[3] and "mwh" in m[3].lower() else None) or (unit_of(m[3]) if m[3] else None) or (_metric(m[1]) if m[1] else None)
        if name and not _is_no_forecast(_stop.split(line[max(0, m.start(2) - 60) : m.start(2)])[-1]):
            out.append((m.start(2), name, number(m[2]) * (1000 if m[3] and "gw" in m[3].lower() else 1)))
    return out


def sentences(text: str) -> list[tuple[str, float, datetime]]:
    """Values with their times. In a line that begins with a value each takes the next time, in others the latest before it; in a line without a time, the
    nearest one of the 140 characters before and the 180 behind, else the last one of an earlier line, else the first of the text."""
    out = []
    every = times_in(text)
    last, at_line = (every[0][2] if every else None), 0
    for line in text.splitlines(keepends=True):
        begin, at_line = at_line, at_line + len(line)
        if line.count("|") >= 2:
            continue
        own = [(lo - begin, hi - begin, at) for lo, hi, at in every if begin <= lo < at_line]
        bare = line
        for lo, hi, _ in own:
            bare = bare[:lo] + " " * (hi - lo) + bare[hi:]
        found = values_in(bare)
        ahead = bool(own and found) and found[0][0] < own[0][0]
        for place, name, value in found:
            before, behind = [t for _, hi, t in own if hi <= place], [t for lo, _, t in own if lo >= place]
            if own:
                at = behind[0] if ahead and behind else before[-1] if before else behind[0]
            else:
                near = [(max(lo - begin - place, place - hi + begin), at) for lo, hi, at in every if -180 <= place + begin - lo and place + begin - hi <= 140]
                at = min(near)[1] if near else last
            if at:
                out.append((name, value, at))
        if own:
            last = own[-1][2]
    return out


def parse(text: str | None, single_ts: datetime | None = None) -> list[tuple[str, float, datetime]]:
    """All rows of a text, told apart and in order of time. Tables are authoritative. single_ts: a point question: the last value of each
    metric, at that time."""
    body = section(clean(text or ""))
    if single_ts is not None and stamp(body) is None:
        body = f"{single_ts:%Y-%m-%d %H:%M:%S}\n{body}"
    rows = tables(body) or sentences(body)
    rows = sorted(dict.fromkeys(rows), key=lambda r: (r[0], r[2]))
    if single_ts is not None:
        rows = [(m, v, single_ts) for m, v in {m: v for m, v, _ in rows}.items()]
    return rows


def parse_column(df: DataFrame, text: str = "answer", point_ts: str | None = None) -> DataFrame:
    """df with a row for each parsed value: metric, value, ts. Arrow batches, no row-wise transfer."""
    import pyarrow as pa

    def run(t: pa.Array, p: pa.Array) -> pa.Array:
        found = [parse(x, y) for x, y in zip(t.to_pylist(), p.to_pylist())]
        metric, value, ts = zip(*(r for rows in found for r in rows)) if any(found) else ((), (), ())
        ends = [0, *accumulate(map(len, found))]
        cells = [pa.array(metric, pa.string()), pa.array(value, pa.float64()), pa.array(ts, pa.timestamp("us"))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cells, ["metric", "value", "ts"]))

    run.__annotations__ = {"t": pa.Array, "p": pa.Array, "return": pa.Array}
    run = F.arrow_udf(run, ROW)
    point = F.col(point_ts).cast("timestamp_ntz") if point_ts else F.lit(None).cast("timestamp_ntz")
    return df.withColumn("_row", F.explode(run(F.col(text), point))).select(*df.columns, "_row.metric", "_row.value", "_row.ts")


def lines(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The common sentence 'yyyy/MM/dd HH:mm:ss : TOTALDEMAND=v and RRP=w', by expressions alone."""
    line = F.explode(F.split(text, "\n")).alias("line")
    at = F.try_to_timestamp(F.regexp_extract("line", r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz")
    value = lambda m: F.regexp_extract("line", rf"{m}\s*=\s*([-+]?[\d,]+(?:\.\d+)?)", 1)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.regexp_replace(value(m), ",", "").try_cast("double").alias("value")) for m in ("TOTALDEMAND", "RRP")])).alias("c")
    return df.select(*keep, line).select(*keep, at.alias("ts"), cells).select(*keep, "c.metric", "c.value", "ts").where("ts is not null and value is not null")


def as_literal(df: DataFrame, key: str) -> DataFrame:
    """One text {'METRIC': [[value, 'ts'], ...]} for each key, sorted by time."""
    cell = F.array_sort(F.collect_list(F.struct("ts", "value")))
    shown = F.transform(cell, lambda x: F.format_string("[%s, '%s']", x["value"].cast("string"), F.date_format(x["ts"], "yyyy/MM/dd HH:mm:ss")))
    one = df.groupBy(key, "metric").agg(F.format_string("'%s': [%s]", F.first("metric"), F.array_join(shown, ", ")).alias("part"))
    return one.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("part")), ", "), F.lit("}")).alias("predicted"))


__all__ = ["as_literal", "clean", "lines", "number", "parse", "parse_column", "sentences", "stamp", "tables", "times_in", "unit_of", "values_in"]
