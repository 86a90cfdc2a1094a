"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL_SCHEMA = "map<string,array<array<string>>>"


def compact(c: Column, digits: int = 2) -> Column:
    """Long decimals cut to digits places, punctuation and repeated white space taken out."""
    short = F.regexp_replace(c, rf"(\d+\.\d{{{digits}}})\d+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(short, r"[\"'{}\[\]]", ""), r"\s+", " "))


def compact_list(c: Column, head: int = 6, tail: int = 3, over: int = 12) -> Column:
    """Of arrays with more than over items the first head and last tail, with … between."""
    return F.when(F.size(c) > over, F.concat(F.slice(c, 1, head), F.array(F.lit("…")), F.slice(c, -tail, tail))).otherwise(c)


def cap(c: Column, n: int = 15_000) -> Column:
    """X18."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def token_count(c: Column) -> Column:
    """X23, offline: a token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def interval_label(mean: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """X24."""
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", mean, lo, hi)


def main_answer(c: Column, keys: tuple[str, ...] = ("answer", "forecast", "result", "text", "summary")) -> Column:
    """The first of keys that a JSON text has, else the text."""
    return F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in keys], c)


def salvage(c: Column) -> Column:
    """X14 over a column: the text from the first brace to the last."""
    return F.when(c.rlike(r"(?s)\{.*\}"), F.regexp_extract(c, r"(?s)\{.*\}", 0))


def literal_map(c: Column) -> Column:
    """{'METRIC': [[value, 'ts'], ...]} with single quotes, as a map of arrays."""
    return F.from_json(F.regexp_replace(F.regexp_replace(c, "'", '"'), r"\b(nan|NaN|None)\b", "null"), LITERAL_SCHEMA)


def values_of(c: Column, metric: str) -> Column:
    """The metric's values."""
    return F.transform(F.try_element_at(literal_map(c), F.lit(metric)), lambda x: F.get(x, F.lit(0)).try_cast("double"))


def stamps_of(c: Column, metric: str) -> Column:
    return F.transform(F.try_element_at(literal_map(c), F.lit(metric)), lambda x: F.try_to_timestamp(F.get(x, F.lit(1)), F.lit("yyyy/MM/dd HH:mm:ss")))


def single(c: Column) -> Column:
    """The only item of an array, else null."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0)))
