"""From a question to evidence, statistics, patterns and a forecast."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_datetime, parse_request, route_of, sector_of
from ..functions.calendar import route_column
from ..functions.requests import request_columns
from ..operators import chunks, patterns, retrieve, stats
from ..operators import questions as tables
from ..spec import ChunkConfig, Filters, Flags, RetrievalConfig, SeriesSpec
from .clients import CallLog, ChatClient, chat
from .windows import target_window


@dataclass
class Answer:
    route: str
    sector: str | None
    filters: Filters
    meta: dict
    forecast: DataFrame
    text: str | None = None
    stats: dict = field(default_factory=dict)
    patterns: DataFrame | None = None
    summary: tuple | None = None
    seconds: dict = field(default_factory=dict)


def forecast(result, spec: SeriesSpec, target: datetime | None, tolerance_minutes: int = 30) -> DataFrame:
    """M14 in numbers: the score-weighted mean of the evidence at the target's time of day (all evidence if there is none)."""
    long = stats.unpivot(result.combined, spec)
    if target is not None:
        minutes = F.abs(F.hour("ts") * 60 + F.minute("ts") - (target.hour * 60 + target.minute))
        near = minutes <= tolerance_minutes
    else:
        near = F.lit(True)
    v, w = F.col("value"), F.col("ret_score")
    same = stats.weighted_mean(F.when(near, v), w)
    return long.groupBy("series", "metric").agg(F.coalesce(same, stats.weighted_mean(v, w)).alias("forecast"), F.sum(near.cast("long")).alias("n_same_slot"), F.count(v).alias("n_evidence"))


def target_label(f: Filters) -> str:
    """X19."""
    start, end = target_window(f)
    if start is None:
        return "next step"
    return f"{start:%Y-%m-%d %H:%M}" + (f" to {end:%Y-%m-%d %H:%M}" if end else "")


def answer(df: DataFrame, spec: SeriesSpec, question: str, client: ChatClient | None = None, flags: Flags = Flags(), cfg: RetrievalConfig = RetrievalConfig(), reference: datetime | None = None, step_seconds: int = 3600, prompt_lines: int = 50) -> Answer:
    """Lazily planned; the only action is the anchor."""
    marks, began = {}, time.time()

    def mark(name: str) -> None:
        nonlocal began
        marks[name], began = time.time() - began, time.time()

    f = parse_request(question, reference)
    known = {g.upper() for g in f.groups}
    anchor = reference or retrieve.anchor_of(df, spec, known)
    if anchor is None:
        raise ValueError("no rows")
    target = target_window(f)[0]
    route = route_of(target, anchor) if flags.horizon else "mid_term"
    sector = sector_of(question) if flags.sector else None
    mark("parse")
    found = retrieve.retrieve(df, spec, route, f, cfg)
    mark("retrieve")
    out = Answer(route, sector, f, found.meta, forecast(found, spec, target, cfg.time_tolerance_minutes))
    if not flags.direct_only:
        if flags.stats:
            out.stats = stats.summarise(found.combined, spec)
        if flags.patterns:
            out.patterns = patterns.by_origin(found.rows, spec, step_seconds)
        if flags.summary:
            chunked = chunks.by_time(found.rows, spec.ts, ChunkConfig().hours or 24, ("ret_block",))
            out.summary = chunks.summarise(chunked, spec.ts, spec.metrics[0], "ret_block")
    if client is not None:
        # a table of groups and metrics; a request holds the first prompt_lines of them by name
        shown = out.forecast.orderBy("series", "metric").limit(prompt_lines).collect()
        lines = [f"{r['series']} {r['metric']}: {r['forecast']}" for r in shown]
        out.text = chat(client, [{"role": "system", "content": f"Explain a forecast for {target_label(f)} ({route})."}, {"role": "user", "content": question + "\n" + "\n".join(lines)}])
    mark("forecast")
    out.seconds = marks
    return out


def trace(a: Answer) -> dict:
    """M21, X21."""
    return {"route": a.route, "sector": a.sector, "filters": {k: v for k, v in asdict(a.filters).items() if v}, "meta": a.meta, "seconds": a.seconds}


def run_one(df: DataFrame, spec: SeriesSpec, exp_id: str, seed: int, question: dict, flags: Flags, client: ChatClient | None = None, prices: dict | None = None) -> tuple[dict, dict]:
    """One run: its record and its trace. A failing run is a record with its error. Tokens and cost are those of the client's calls."""
    began, error, found = time.time(), "", None
    log = CallLog(client, "forecast", prices=prices or {}) if client is not None else None
    said = ""
    try:
        found = answer(df, spec, question["text"], client=log, flags=flags, reference=iso_datetime(question.get("reference")))
        shown = found.forecast.orderBy("series", "metric").limit(50).collect()
        said = found.text or "; ".join(f"{r['series']} {r['metric']}={r['forecast']}" for r in shown)
    except Exception as e:  # whatever goes wrong in a run belongs in its record
        error = f"{type(e).__name__}: {e}"
    calls = log.calls if log else []
    total = lambda k: sum(c[k] for c in calls)
    run_id = f"{exp_id}-{seed}-{question['id']}"
    record = {"run_id": run_id, "exp_id": exp_id, "seed": seed, "query_id": question["id"], "route": found.route if found else "", "answer": said, "tokens_in": total("tokens_in"), "tokens_out": total("tokens_out"), "cost_usd": float(total("cost_usd")), "latency_sec": float(total("latency_sec")), "wall_clock_sec": time.time() - began, "error": error}
    return record, {"run_id": run_id, "calls": calls} | (trace(found) if found else {})


RUN_SCHEMA = "run_id string, exp_id string, seed int, query_id string, route string, answer string, tokens_in long, tokens_out long, cost_usd double, latency_sec double, wall_clock_sec double, error string, trace_path string"


def run_questions(df: DataFrame, spec: SeriesSpec, questions: DataFrame, setups: dict[str, Flags], seeds: tuple[int, ...] = (42,), cfg: RetrievalConfig = RetrievalConfig(), lines: int = 50) -> DataFrame:
    """M26 without a client, for any number of questions (id, text, and perhaps reference: a time that stands for the latest one in choosing a route): the record of
    each setup, seed and question. Evidence is retrieved once for each question and route, in one pass over df; nothing runs on the driver."""
    given = questions.select(F.col("id").cast("string").alias("query_id"), "text", F.col("reference").cast("timestamp_ntz").alias("reference") if "reference" in questions.columns else F.lit(None).cast("timestamp_ntz").alias("reference"))
    asked = request_columns(given).select("query_id", "reference", "groups", "times", "target_start", "target_end", "freq")
    runs = F.explode(F.array(*[F.struct(F.lit(e).alias("exp_id"), F.lit(s).alias("seed"), F.lit(f.horizon).alias("horizon")) for e, f in setups.items() for s in seeds])).alias("r")
    known = tables.anchored(tables.normalised(asked.withColumnRenamed("query_id", "question_id").withColumn("route", F.lit("mid_term"))), df, spec).withColumnRenamed("question_id", "query_id").drop("route")
    routed = known.join(asked.select("query_id", "reference"), "query_id").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("horizon"))
    routed = routed.withColumn("route", F.when(F.col("horizon"), route_column(F.col("target_start"), F.coalesce("reference", "anchor"))).otherwise("mid_term"))
    own = routed.where(F.col("horizon").isin(sorted({f.horizon for f in setups.values()}))).withColumn("question_id", F.concat_ws("\x1f", "query_id", "route"))
    each = own.drop("query_id", "reference", "horizon").dropDuplicates(["question_id"])
    found = tables.forecasts(tables.retrieve_all(df, spec, each, cfg), spec, each, cfg.time_tolerance_minutes)
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy("series", "metric"))).where(F.col("_k") <= lines)
    said = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.col("series"), F.lit(" "), F.col("metric"), F.lit("="), F.col("forecast").cast("string")).alias("t")))), lambda x: x["t"])
    texts = first.groupBy("question_id").agg(F.array_join(said, "; ").alias("answer"))
    every = given.select("query_id", runs).select("query_id", "r.*").join(own.select("query_id", "horizon", "route", "question_id"), ["query_id", "horizon"], "left").join(texts, "question_id", "left")
    run_id = F.concat_ws("-", "exp_id", F.col("seed").cast("string"), "query_id")
    error = F.when(F.col("question_id").isNull(), "no rows for the requested groups").otherwise("")
    return every.select(run_id.alias("run_id"), "exp_id", "seed", "query_id", F.coalesce("route", F.lit("")).alias("route"), F.coalesce("answer", F.lit("")).alias("answer"), error.alias("error"))


def run_ablations(spark: SparkSession, df: DataFrame, spec: SeriesSpec, questions: list[dict], setups: dict[str, Flags], seeds: tuple[int, ...] = (42,), client: ChatClient | None = None, prices: dict | None = None, folder: str | None = None, at_once: int = 4) -> DataFrame:
    """A record for each setup, seed and question, in that order; at_once runs share the session. folder: also a JSON file of each run's trace."""
    asked = [(exp_id, seed, q, flags) for exp_id, flags in setups.items() for seed in seeds for q in questions]
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(lambda a: run_one(df, spec, a[0], a[1], a[2], a[3], client, prices), asked))
    if folder:
        traces = spark.createDataFrame([(t["run_id"], json.dumps(t, default=str)) for _, t in done], "run_id string, value string")
        traces.write.mode("append").partitionBy("run_id").text(folder)
    return spark.createDataFrame([(*r.values(), f"{folder}/run_id={r['run_id']}" if folder else None) for r, _ in done], RUN_SCHEMA)
