"""Tables of natural-language requests: the rules of calendar.parse_request and its helpers, row by row in Arrow batches."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calendar

REQUEST = "groups array<string>, metrics array<string>, times array<string>, date_start string, date_end string, target_start timestamp_ntz, target_end timestamp_ntz, weekdays array<string>, weekends boolean, holidays boolean, freq string, vague_tolerance int, horizon_steps int, horizon_units string, dates array<date>"


@lru_cache(maxsize=1 << 14)
def _asked(said: str | None, compat: bool) -> tuple:
    """The values of REQUEST for a text. Workers keep those of the texts they met last."""
    from ..plans.windows import target_window

    f = calendar.parse_request(said or "")
    start, end = target_window(f, compat)
    return (list(f.groups), list(f.metrics), list(f.times), f.date_start, f.date_end, start, end, list(f.weekdays), f.weekends, f.holidays, f.freq, f.vague_tolerance_minutes, f.horizon_steps, f.horizon_units, calendar.concrete_dates(replace(f, years=(), months=(), days=())))


def request_columns(df: DataFrame, text: str = "text", compat: bool = False) -> DataFrame:
    """Df with the columns of REQUEST. A null text asks for nothing. A text is parsed once for all its rows of a batch."""
    import pyarrow as pa

    names = [c.split(" ")[0] for c in REQUEST.split(", ")]
    simple = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<date>": pa.list_(pa.date32())}
    kinds = [simple[c.split(" ")[1]] for c in REQUEST.split(", ")]
    own = df.drop(*names)
    at = own.columns.index(text)

    def rows(batches):
        for b in batches:
            coded = b.column(at).dictionary_encode()
            made = [_asked(s, compat) for s in [*coded.dictionary.to_pylist(), None]]
            which = coded.indices.fill_null(len(made) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k).take(which) for c, k in zip(zip(*made), kinds)]], names=[*b.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(rows, f"{kept}, {REQUEST}")


def answers(df: DataFrame, text: str, schema: dict, keep: int = 200) -> DataFrame:
    """Df with the object that a text holds (JSON, keys sorted; else its first keep characters as text) and what a schema finds wrong with it."""
    import pandas as pd

    def run(said: pd.Series) -> pd.DataFrame:
        found = [calendar.salvage_json(s, keep) for s in said]
        return pd.DataFrame({"object": [json.dumps(x, sort_keys=True) for x in found], "errors": [", ".join(calendar.schema_errors(x, schema)) for x in found]})

    run.__annotations__ = {"said": pd.Series, "return": pd.DataFrame}
    return df.withColumn("_a", F.pandas_udf(run, "object string, errors string")(F.col(text))).select(*df.columns, "_a.object", "_a.errors")
