"""What the operators of this subpackage share: the shared folder, written intermediates, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_held: dict = {}
_written: set[str] = set()

#: Class of the white space that the text contracts name, as a regular expression for Java and Python.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = rb"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset and everything runs in this process (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return _own_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Delete whatever this session's operators have written to the shared folder and not deleted yet: what results are read from. Call it once they are
    stored. The number of folders."""
    gone = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*written: DataFrame) -> None:
    """Delete the files of materialised intermediates that nothing reads any more, and let Spark's cleaner delete the shuffle files of finished jobs."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
            _written.difference_update([p for p in _written if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]])
    if written:
        written[0].sparkSession._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(key: tuple, make):
    """What a Python worker keeps between tasks, under a key that names its contents. Workers outlive stages, so that only one entry is kept."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): each node that has an edge with the smallest node it reaches.

    Hooks every node to its smallest neighbour, jumps pointers twice, contracts the edges, and repeats until no edge
    is left: rounds grow with the logarithm of the longest path. Hubs are pre-aggregated by min(); every round is a written table.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "cc-labels")
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e"))
        parent = materialise(both.groupBy("e.v").agg(F.least("v", F.min("e.u")).alias("p")), "cc-parent")
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "cc-jump")
            forget(parent)
            parent = jumped
        hook = parent.select(F.col("v").alias("component"), "p")
        new_labels = materialise(labels.join(hook, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
        to_a, to_b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        new_edges = materialise(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "cc-edges")
        forget(labels, edges, parent)
        labels, edges = new_labels, new_edges
    return labels
