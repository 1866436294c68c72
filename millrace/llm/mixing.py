"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, small, table, written

#: Up to so many sources their targets are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def fill(sizes: DataFrame, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Adds ``target`` to sizes(source, source_size, weight).

    share * (sum of sizes) is dealt by weight; a source stops at epochs * its size and what it leaves is dealt to the
    others by weight, until none is above. That end state has one water level: with sources in the order of
    cap / weight, those before some position stop at their cap and the rest get level * weight. One window over the
    table of sources (one row per source) finds it. Without sources the result is empty; if even all caps hold less
    than the total, every source gets its cap.
    """
    cap = F.col("source_size") * F.lit(epochs)
    order = W.orderBy((cap / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    found = sizes.withColumn("level", level)
    # the first source that the level does not lift over its cap sets the level for itself and all after it
    found = found.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(F.col("source_size") * epochs / F.col("weight"), "rank", "level"))).over(everything)["level"])
    return found.withColumn("target", F.coalesce(F.least(cap.cast("double"), F.col("level") * F.col("weight")), cap.cast("double"))).drop("level")


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix", digits: int = 3) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target``, ``taken`` and ``repeats`` (columns of these names are replaced).

    Sources by code point, null last, have the weights in turn. A source of e = target / source_size epochs takes each
    document floor(e) times and, in the order of a seeded hash of the id, documents once more until the rest of the
    target is reached; the document on the edge is taken if half of it or more fits. So a source's sum is within
    half a document of its target, no document is taken more than ``epochs`` times, and reruns agree.

    The order is not sorted: sums by source and leading hash digits (combined before the shuffle) name the one bin in
    which a source's edge lies; only documents in that bin are ordered, 1 of 16^digits of the source.

    Null text has size 0, a null source is a source, a null id hashes as empty; rows that agree in id and size are
    interchangeable. An empty table gives an empty result.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    d = docs.drop("size", "source_size", "target", "taken", "repeats").withColumns({"size": size, "__code": code})
    d = d.withColumn("__bin", F.substring("__code", 1, digits))
    bins = written(d.groupBy(F.col(source_col).alias("source"), F.col("__bin").alias("bin")).agg(F.sum("size").alias("n")), "bins")
    sizes = bins.groupBy("source").agg(F.sum("n").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    sizes = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    plan = fill(sizes, share, epochs)
    whole = F.when(F.col("source_size") == 0, 0).when(F.col("target") >= F.col("source_size") * epochs, epochs).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("rank", "weight")
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
    edge = bins.withColumn("upto", upto).withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).where("upto > rest")
    edge = edge.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("edge"))
    plan = plan.join(edge.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    plan = small(written(plan.select(F.col("source").alias("__source"), "source_size", "target", F.col("whole").alias("__whole"), F.col("rest").alias("__rest"), F.col("edge.bin").alias("__edge"), F.col("edge.before").alias("__before")), "plan"), BROADCAST_SOURCES)
    d = d.join(plan, F.col(source_col).eqNullSafe(F.col("__source")))
    at_edge = F.coalesce(F.col("__bin") == F.col("__edge"), F.lit(False))
    clear = d.where(~at_edge).withColumn("repeats", F.col("__whole") + F.coalesce(F.col("__bin") < F.col("__edge"), F.lit(True)).cast("int"))
    run = F.sum("size").over(W.partitionBy(source_col).orderBy("__code", F.col(id_col), "size").rowsBetween(W.unboundedPreceding, 0))
    close = d.where(at_edge).withColumn("repeats", F.col("__whole") + (F.col("__before") + run - F.col("size") / 2 <= F.col("__rest")).cast("int"))
    out = clear.unionByName(close).withColumn("taken", F.col("size") * F.col("repeats"))
    return out.drop("__code", "__bin", "__source", "__whole", "__rest", "__edge", "__before")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs.select("doc_id", "source", count_words(F.col("text")).alias("n")), F.col("n"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
l AS (SELECT first(level ORDER BY cap / weight, rank) AS level FROM o WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l) * weight, cap::DOUBLE)) AS target, cap FROM o),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= cap THEN 2 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::DOUBLE AS run FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
