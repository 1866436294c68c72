"""What the text operators share: words, folders for intermediate tables, components of a link graph."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names.

    Only where one machine is all there is (a local master, as in tests) and none is named, a temporary one serves, until
    the process ends; on a cluster that is an error, for executors do not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable from any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def parts(df: DataFrame, mb: float = 16) -> int:
    """A number of parts for df's rows so that one holds about mb megabytes of what df's files hold."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(1, min(1 << 20, int(int(str(size)) / (mb * 1e6)) + 1))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links(a, b), for every node that a link touches.

    Alternates the large-star and small-star contractions until the edges are stars. A hub only ever meets its own
    smallest neighbour, so a step handles each edge once, aggregates per node are combined before the shuffle and the
    joins are left to adaptive skew handling. Self-links and repeated links change nothing; null ends are ignored.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.hash("v", "u").cast("long"))).first()
        if state == seen or not seen[0]:
            break
        state = seen
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("c")).agg(F.min(F.least("v", "u")).alias("m"))
        large = edges.join(least, F.col("u") == F.col("c")).select("v", F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        step = large.join(low, F.col("v") == F.col("c")).select("v", "u", "m")
        step = step.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        after = written(step.where("v <> u").distinct(), "edges")
        forget(edges)
        edges = after
    # one row for each node: all are stars now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
