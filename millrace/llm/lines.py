"""Line dedup: a segment-partition edit join finds lines within a few edits of each other. DataFrame and SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, small, table, written

#: Shorter lines (code points) are compared for equality only: an edit is much of them.
MIN_CHARS = 20
#: A key that more than so many different lines share is divided: its lines meet by so many finer keys instead, and so on.
HOT = 16
FINER = 16
BROADCAST_ROWS = 500_000

HAS_WORD = r"[^\x20\x09-\x0D]"


def _segments(n: Column, parts: int) -> list[tuple[Column, Column]]:
    """(start, length) of ``parts`` even segments of a line of n code points; the last are the longer ones."""
    base, over = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    out = []
    for i in range(parts):
        longer = F.greatest(F.lit(i) - (parts - over), F.lit(0))
        out.append((base * i + longer + 1, base + (F.lit(i) >= parts - over).cast("int")))
    return out


def segment_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """(key, kind, seg, at) of a line: its own segments (kind 0), and where segments of shorter lines could lie in it (kind 1).

    A line within ``edits`` edits of a line of n - gap code points contains one of that line's edits + 1 segments, shifted
    no further than the edits before and behind the segment allow. With gap 0 and no shift these are the line's own.
    """
    out = []
    for gap in range(edits + 1):
        for i, (start, length) in enumerate(_segments(n - gap, edits + 1)):
            low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                own = gap == 0 and shift == 0
                piece = F.substring(line, start + shift, length)
                found = F.struct(F.xxhash64((n - gap), F.lit(i), piece).alias("key"), F.lit(0 if own else 1).alias("kind"), F.lit(i).alias("seg"), F.lit(gap).alias("gap"))
                # with one edit a segment's only place is always inside
                out.append(found if edits <= 1 else F.when((start + shift >= 1) & (start + shift + length - 1 <= n), found))
    return out


def _rest(line: Column, n: Column, seg: Column, gap: Column) -> Column:
    """What a line has besides the segment it shares, for one edit: its other half, longer by ``gap`` than the shorter line's."""
    (_, first), (_, last) = _segments(n - gap, 2)
    return F.when(seg == 0, F.substring(line, first + 1, n)).otherwise(F.substring(line, F.lit(1), n - last))


def _divided(members: DataFrame, hot: DataFrame) -> DataFrame:
    """members(h1, h2, kind, gap, key, rest) of ``hot`` keys under finer ones: the rest is equal but for one of FINER stretches."""
    size = F.length("rest") - F.col("gap")  # of the shorter line's rest
    cut = lambda j: F.floor(size * j / FINER).cast("int")
    rows = members.join(small(hot, BROADCAST_ROWS), F.col("key") == F.col("hot")).select("h1", "h2", "kind", "gap", "key", "rest", F.explode(F.sequence(F.lit(0), F.lit(FINER - 1))).alias("j"))
    rows = rows.withColumns({"a": cut(F.col("j")), "behind": size - cut(F.col("j") + 1)}).where((size - F.col("behind") > F.col("a")) | (size == 0) & (F.col("j") == 0) | (F.col("gap") == 1))
    tail = F.when(F.col("behind") > 0, F.right("rest", F.col("behind"))).otherwise("")
    finer = F.xxhash64("key", "j", F.substring("rest", F.lit(1), F.col("a")), tail)
    rows = rows.select("h1", "h2", "kind", "gap", finer.alias("key"), F.substring("rest", F.col("a") + 1, F.length("rest") - F.col("a") - F.col("behind")).alias("rest"))
    alone = rows.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("kind").alias("own")).where("x <> y AND own = 0").select(F.col("key").alias("k"))
    return rows.distinct().join(alone, F.col("key") == F.col("k"), "left_semi")


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line, h1, h2) of the lines with a word; th: hash of the text, h1 and h2: 128 bits for the line."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    return d.where(F.rlike("line", F.lit(HAS_WORD))).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def near_lines(lines: DataFrame, edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a1, a2, b1, b2): each pair of different lines of lines(h1, h2, line) within ``edits`` edits, once, by their hashes.

    Both have ``min_chars`` code points or more. Lines that share a segment key meet; equal lines are one. Where more
    than HOT lines share a key and one edit is asked for, they meet by finer keys of the rest of the line, and those that
    still share one by finer ones again, down to the single place where they differ: lines of a common form (records,
    log lines) come together only if they are within the edit. For more edits segments are not divided. Distances are
    banded (at most ``edits``) and of candidates only.
    """
    fit = lines.withColumn("n", F.length("line")).where(F.col("n") >= max(min_chars, edits + 1)).select("h1", "h2", "line", "n")
    keyed = fit.select("h1", "h2", F.explode(F.array(*segment_keys(F.col("line"), F.col("n"), edits))).alias("k")).where("k IS NOT NULL").select("h1", "h2", "k.*")
    shared = keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("kind").alias("own")).where("x <> y AND own = 0").select("key")
    shared = written(shared, "shared")
    members = written(keyed.join(small(shared, BROADCAST_ROWS), "key").distinct(), "segments")
    ids = written(members.select(F.col("h1").alias("w1"), F.col("h2").alias("w2")).distinct(), "wanted")
    texts = fit.join(small(ids, BROADCAST_ROWS), (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")), "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    texts = written(texts.withColumn("n", F.length("line")), "texts")
    used, meeting = [shared, members, ids], [members.select("h1", "h2", "kind", "key")]
    while edits == 1:
        # of single places, nothing is left to divide
        long = F.max(F.length("rest") - F.col("gap")) > 1 if "rest" in members.columns else F.lit(True)
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), long.alias("long"))
        hot = written(sizes.where((F.col("size") > HOT) & F.col("long")).select(F.col("key").alias("hot")), "hot")
        used.append(hot)
        if hot.isEmpty():
            break
        meeting[-1] = meeting[-1].join(small(hot, BROADCAST_ROWS), F.col("key") == F.col("hot"), "left_anti")
        if "rest" not in members.columns:
            members = members.join(texts, ["h1", "h2"]).withColumn("rest", _rest(F.col("line"), F.col("n"), F.col("seg"), F.col("gap")))
        members = written(_divided(members, hot), "finer")
        used.append(members)
        meeting.append(members.select("h1", "h2", "kind", "key"))
    members = reduce(DataFrame.union, meeting)
    own = members.where("kind = 0").select(F.col("key"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    probes = members.select(F.col("key").alias("p"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), "kind")
    met = own.join(probes, (F.col("key") == F.col("p")) & ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))) & ((F.col("kind") == 1) | (F.struct("a1", "a2") < F.struct("b1", "b2"))))
    met = written(met.select("a1", "a2", "b1", "b2").distinct(), "candidates")
    forget(*used)
    a, b = (texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"{x}t")) for x in "ab")
    pairs = met.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    close = pairs.where(F.levenshtein("at", "bt", edits).between(1, edits))
    order = F.struct("a1", "a2") < F.struct("b1", "b2")
    sides = [F.when(order, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a1", "b1"), ("a2", "b2"))] + [F.when(order, F.col(y)).otherwise(F.col(x)).alias(y) for x, y in (("a1", "b1"), ("a2", "b2"))]
    links = written(close.select(*sides).distinct(), "links")
    forget(met, texts)
    return links


def dedup_lines(docs: DataFrame, edits: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``n_lines``, ``n_dropped``, ``n_links`` and ``kept_text`` (columns of these names are replaced).

    Lines are what newlines separate; those without a word stay and count for nothing. Lines are ordered by id (null
    first), hash of the text and place. Of equal lines the first stays. It goes too if an earlier line's first is within
    ``edits`` edits, whether that one stays or not. n_links: pairs within the edits that the lines kept or dropped here as
    first ones are in. Null text keeps nothing and stays null. Rows that repeat an id and text share their decisions.
    """
    docs = docs.drop("n_lines", "n_dropped", "n_links", "kept_text")
    lines = _exploded(docs, id_col, text_col)
    firsts = written(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "no")).alias("first")), "firsts")
    links = near_lines(lines, edits, min_chars)
    a, b = (firsts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"{x}f")) for x in "ab")
    placed = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    ends = placed.select(F.explode(F.array(F.struct(F.col("a1").alias("e1"), F.col("a2").alias("e2"), (F.col("bf") < F.col("af")).alias("later")), F.struct(F.col("b1").alias("e1"), F.col("b2").alias("e2"), (F.col("af") < F.col("bf")).alias("later")))).alias("e")).select("e.*")
    ends = ends.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("links"), F.max("later").alias("later"))
    judged = firsts.join(ends, (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), "left")
    kept = judged.groupBy("first.id", "first.th").agg(F.array_sort(F.collect_list(F.when(~F.coalesce("later", F.lit(False)), F.col("first.no")))).alias("at"), F.sum(F.coalesce("links", F.lit(0))).alias("__links"))
    # a flag for each line up to the last one kept
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0)))), "at", lambda p, q: F.concat(F.repeat(F.lit("0"), q - p - 1), F.lit("1")))
    flags = F.when(F.size("at") > 0, F.split(F.array_join(gaps, ""), "")).otherwise(F.array().cast("array<string>"))
    kept = written(kept.select(F.col("id").alias("__id"), F.col("th").alias("__th"), flags.alias("__flags"), "__links"), "kept")
    forget(firsts, links)
    joined = docs.withColumn("__h", F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    word = lambda x: F.rlike(x, F.lit(HAS_WORD))
    split = F.split(text_col, "\n")
    stay = F.filter(split, lambda x, i: ~word(x) | (F.coalesce(F.get("__flags", i), F.lit("0")) == "1"))
    count = lambda c: F.coalesce(F.size(F.filter(c, word)), F.lit(0)).cast("long")
    out = joined.withColumn("__stay", stay).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(count(split)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines") - count(F.col("__stay"))).cast("long"))
    return out.withColumn("n_links", F.coalesce("__links", F.lit(0)).cast("long")).withColumn("kept_text", F.array_join("__stay", "\n")).drop("__h", "__id", "__th", "__flags", "__links", "__stay")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_links", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
y AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM x),
f AS (SELECT line, first(doc_id ORDER BY doc_id, i) AS d, first(i ORDER BY doc_id, i) AS i FROM y WHERE word GROUP BY line),
m AS (SELECT a.line AS a, b.line AS b, (b.d, b.i) < (a.d, a.i) AS b_first FROM f a JOIN f b ON length(b.line) BETWEEN length(a.line) AND length(a.line) + 1 AND length(a.line) >= 20 AND a.line <> b.line AND (length(a.line) < length(b.line) OR a.line < b.line)
  AND (left(a.line, length(a.line) // 2) = left(b.line, length(a.line) // 2) OR right(a.line, length(a.line) - length(a.line) // 2) = right(b.line, length(a.line) - length(a.line) // 2)) AND len(list_filter(range(1, length(b.line) + 1), lambda i: left(a.line, i - 1) = left(b.line, i - 1) AND substr(a.line, i + 1 - (length(b.line) - length(a.line))) = substr(b.line, i + 1))) > 0),
e AS (SELECT line, count(*) AS n, bool_or(late) AS late FROM (SELECT a AS line, b_first AS late FROM m UNION ALL SELECT b, NOT b_first FROM m) GROUP BY line),
z AS (SELECT y.*, f.line IS NOT NULL AS is_first, coalesce(e.late, false) AS late, coalesce(e.n, 0) AS n FROM y LEFT JOIN f ON y.line = f.line AND y.doc_id = f.d AND y.i = f.i LEFT JOIN e ON y.line = e.line)
SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (word AND NOT (is_first AND NOT late)) AS n_dropped, coalesce(sum(n) FILTER (word AND is_first), 0)::BIGINT AS n_links,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT word OR (is_first AND NOT late)), '')) AS kept_sha256 FROM z GROUP BY doc_id
"""
