"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

WIDTH = 5
#: Sketch values or candidate documents up to this number are broadcast (16 to 32 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(w: str) -> Column:
    """Distinct shingles of the column ``w`` of words; fewer than WIDTH words are one shingle, none give an empty array."""
    n = F.size(w)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - WIDTH + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, WIDTH), " "))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def hashes(w: str) -> Column:
    """64-bit hash of each shingle of the column ``w``, in order, repeats included."""
    n = F.size(w)
    five = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)]))
    return F.when(n >= WIDTH, five).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(value, item): the MinHash sketch of each item(item, w).

    Items are partitioned by the size of their sets, to powers of two. A class's sketch is its items' so many smallest
    hashes: one more than a set of the class's largest size can miss at ``percent``. A document that holds enough of an
    item therefore holds at least one value of its sketch, whatever the document's own size.
    """
    h = items.select("item", F.array_sort(F.array_distinct(hashes("w"))).alias("h"))
    most = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h").cast("double"))))
    length = (most - F.ceil(most * percent / 100) + 1).cast("int")
    return h.where(F.size("h") > 0).select(F.explode(F.slice("h", F.lit(1), length)).alias("value"), "item")


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, n_item, n_shared) of each document that has percent/100 or more of an item's distinct shingles.

    Words are lower-cased. Null and empty texts have no shingles: such items match nothing. A set of fewer than
    WIDTH words has one shingle, so short items are found as whole documents only. Null ids count as an id; rows that
    repeat an id give a pair if any of their texts does, once. Other columns are ignored. Documents with a sketch value
    of an item are candidates; these alone are read again and compared shingle by shingle.
    """
    bench = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).distinct()
    bench = written(bench, "items")
    sketch = small(written(sketches(bench, percent).distinct(), "sketch"), BROADCAST_ROWS)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    probes = source.select("id", words(F.col("text")).alias("w")).select("id", F.explode(hashes("w")).alias("value"))
    found = written(probes.join(sketch, "value").select("id", "item").distinct(), "candidates")
    wanted = small(written(found.select(F.col("id").alias("wanted")).distinct(), "wanted"), BROADCAST_ROWS)
    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("id", words(F.col("text")).alias("w"))
    sets = texts.select(F.col("id").alias("d"), shingles("w").alias("doc_set"))
    asked = bench.select(F.col("item").alias("i"), shingles("w").alias("item_set"))
    pairs = found.join(asked, F.col("item").eqNullSafe(F.col("i"))).join(sets, F.col("id").eqNullSafe(F.col("d")))
    pairs = pairs.select("id", "item", F.size("item_set").cast("long").alias("n_item"), F.size(F.array_intersect("item_set", "doc_set")).cast("long").alias("n_shared"))
    best = pairs.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("id", "item").agg(F.max(F.struct("n_shared", "n_item")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.n_item").alias("n_item"), F.col("best.n_shared").alias("n_shared"))


def drop_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak an item."""
    gone = written(find_leaks(docs, items, percent, id_col, text_col).select(F.col(id_col).alias("__gone")).distinct(), "leaking")
    return docs.join(small(gone, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
p AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared FROM p JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n
"""
