"""Substring dedup: windows that share a minimiser travel as one super-k-mer to its bucket, where sorting counts them."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table
from .exchange import Blocks, Documents, blocked, pack, runs, unpack
from .shingles import PLACES, U, mix

WINDOW = 35
#: Words of the runs from which a window's minimiser is chosen.
MINIMISER = 5
#: Windows whose minimisers are found at once, and the bits that hold a place among them.
CHUNK, PLACE_BITS = 1 << 20, 22
#: Runs that send more than HOT_BYTES to their bucket, judged by one block in SAMPLE (64 blocks at most), are a
#: minimiser only of windows that have no other run. This deals the work; results do not depend on it.
SAMPLE, MOST_SAMPLED, HOT_BYTES, SURE = 16, 64, 1 << 20, 32


def hashed_runs(words: list[bytes], m: int) -> np.ndarray:
    """64-bit hashes of the runs of m words."""
    n = len(words)
    h = mix(np.fromiter(map(crc32, words), U, n))
    out = h[: n - m + 1] * PLACES[0]
    for j in range(1, m):
        out = out + h[j : n - m + 1 + j] * PLACES[j]
    return mix(out)


def super_kmers(documents: list[list[bytes]], window: int, n_buckets: int, hot: np.ndarray | None = None):
    """(all words, first windows, last windows, buckets) of the maximal runs of windows with the same minimiser.

    A window's minimiser is the leftmost of its word runs with the smallest hash, those of ``hot`` (sorted) behind all
    others: equal windows have equal ones.
    """
    words = [w for d in documents for w in d]
    n, m = len(words), min(MINIMISER, window)
    none = np.zeros(0, np.int64)
    if n < window:
        return words, none, none, none
    key = hashed_runs(words, m)
    order = key >> U(1)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        order |= (hot[at] == key).astype(U) << U(63)
    width, low, chosen = window - m + 1, U((1 << PLACE_BITS) - 1), []
    for a in range(0, n - window + 1, CHUNK):
        best = order[a : a + CHUNK + width - 1]
        best, reach = (best & ~low) | np.arange(len(best), dtype=U), 1
        while 2 * reach <= width:
            best = np.minimum(best[: len(best) - reach], best[reach:])
            reach *= 2
        if reach < width:
            best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
        chosen.append((best & low).astype(np.int64) + a)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    inside = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(inside):
        return words, none, none, none
    place = np.concatenate(chosen)[inside]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[inside[1:]] != owner[inside[:-1]])]))
    first, last = inside[new], inside[np.concatenate([new[1:], [len(inside)]]) - 1]
    return words, first, last, (mix(key[place[new]]) % U(n_buckets)).astype(np.int64)


def _by_bucket(documents, window: int, n_buckets: int, hot: np.ndarray):
    """(bucket, distinct packed strings in order, index of each among them, which super-k-mers) for each bucket, and all of them."""
    words, first, last, bucket = super_kmers(documents, window, n_buckets, hot)
    order = np.argsort(bucket, kind="stable")
    cuts = runs(bucket[order])
    groups = []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        own = order[a:b]
        strings = [b" ".join(words[first[i] : last[i] + window]) for i in own]
        distinct = sorted(set(strings))
        number = {s: i for i, s in enumerate(distinct)}
        groups.append((int(bucket[own[0]]), distinct, np.fromiter(map(number.__getitem__, strings), np.int64, len(strings)), own))
    return words, first, last, groups


SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("strings", T.BinaryType()), T.StructField("twice", T.BinaryType())])
TOLD = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("windows", T.BinaryType())])


def _hot_runs(window: int, least: int):
    """The runs that stand in a sampled block ``least`` times or more, with their number."""

    def apply(batches):
        for batch in batches:
            words = [(t or b"").split() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            keys = [hashed_runs(w, min(MINIMISER, window)) for w in words if len(w) >= window]
            run, times = np.unique(np.concatenate([*keys, np.zeros(0, U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(run[times >= least].view(np.int64)), pa.array(times[times >= least])], ["run", "times"])

    return apply


def hot_runs(cut: Blocks, window: int) -> np.ndarray:
    """The hashes of runs so frequent that their windows would crowd a bucket: at most one in SURE words of the sample."""
    sampled = min(MOST_SAMPLED, -(-cut.n // SAMPLE))
    least = max(SURE, HOT_BYTES * sampled // (cut.n * 8 * window))
    seen = cut.loose.where(F.pmod("__h1", F.lit(cut.n)) < sampled).select("__text").mapInArrow(_hot_runs(window, 2), "run long, times long")
    found = seen.groupBy("run").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("run").toPandas()
    return np.sort(found["run"].to_numpy(np.int64).view(U))


def _send(window: int, n_buckets: int, hot):
    def apply(block: pa.Table) -> pa.Table:
        documents = Documents(block)
        _, _, _, groups = _by_bucket([t.split() for t in documents.texts], window, n_buckets, hot.value)
        several = documents.column("__times").to_numpy().max() > 1  # texts that stand for many rows: each window is there twice
        rows = [(b, documents.number, pack(b"\n".join(distinct)), np.packbits(several | (np.bincount(index, minlength=len(distinct)) > 1)).tobytes()) for b, distinct, index, _ in groups]
        return pa.Table.from_pylist([dict(zip(SENT.names, r)) for r in rows], to_arrow_schema(SENT))  # noqa: B905

    return apply


def repeated(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For the windows of ids at starts, which stand for counts occurrences each: is their sequence there twice or more?

    Sorted by a 64-bit hash; neighbours with equal hashes are compared word by word, so the answer is exact.
    """
    n = len(starts)
    out = counts > 1
    if not n:
        return out
    base = 0x9E3779B97F4A7C15
    power = np.cumprod(np.concatenate([[U(1)], np.full(len(ids), U(base))]))
    back = np.cumprod(np.concatenate([[U(1)], np.full(len(ids), U(pow(base, -1, 1 << 64)))]))
    total = np.concatenate([[U(0)], np.cumsum(mix(ids.astype(U) + U(1)) * power[:-1])])
    value = (total[starts + window] - total[starts]) * back[starts]
    order = np.argsort(value, kind="stable")
    s = value[order]
    pairs = np.flatnonzero(s[1:] == s[:-1])
    steps = np.arange(window)
    same = np.zeros(len(pairs), bool)
    for a in range(0, len(pairs), 50_000):
        p = pairs[a : a + 50_000]
        same[a : a + 50_000] = (ids[starts[order[p]][:, None] + steps] == ids[starts[order[p + 1]][:, None] + steps]).all(1)
    out[order[pairs[same]]] = out[order[pairs[same] + 1]] = True
    for a in pairs[~same]:  # equal hashes of different windows: count that run by its words
        lo, hi = np.searchsorted(s, s[a], "left"), np.searchsorted(s, s[a], "right")
        seen: dict[bytes, int] = {}
        keys = [ids[starts[i] : starts[i] + window].tobytes() for i in order[lo:hi]]
        for k, i in zip(keys, order[lo:hi]):  # noqa: B905
            seen[k] = seen.get(k, 0) + int(counts[i])
        for k, i in zip(keys, order[lo:hi]):  # noqa: B905
            out[i] = seen[k] > 1
    return out


def _count(window: int):
    def apply(bucket: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        times: list[int] = []
        sent = []
        for row in bucket.to_pylist():
            strings = unpack(row["strings"]).split(b"\n")
            twice = np.unpackbits(np.frombuffer(row["twice"], np.uint8))[: len(strings)].tolist()
            own = []
            for s, t in zip(strings, twice):  # noqa: B905
                i = number.setdefault(s, len(times))
                if i == len(times):
                    times.append(0)
                times[i] += 1 + t
                own.append(i)
            sent.append((row["block"], np.array(own)))
        b = bucket.column("bucket")[0].as_py()
        sizes = np.fromiter((s.count(b" ") + 1 for s in number), np.int64, len(number))
        ids = pa.array(b" ".join(number).split(), pa.binary()).dictionary_encode().indices.to_numpy()
        per = sizes - window + 1
        offset = np.cumsum(per) - per
        inner = np.arange(per.sum()) - np.repeat(offset, per)
        twice = repeated(ids, np.repeat(np.cumsum(sizes) - sizes, per) + inner, np.repeat(np.array(times), per), window)
        out = []
        for block, own in sent:
            n = per[own]
            at = np.repeat(offset[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if twice[at].any():
                out.append({"block": block, "bucket": b, "windows": pack(np.packbits(twice[at]).tobytes())})
        return pa.Table.from_pylist(out, to_arrow_schema(TOLD))

    return apply


MADE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def _remove(window: int, n_buckets: int, hot):
    def make(block: Documents, told: pa.Table) -> tuple[list, list, list]:
        documents = [t.split() for t in block.texts]
        words, first, last, groups = _by_bucket(documents, window, n_buckets, hot.value)
        answers = {r["bucket"]: r["windows"] for r in told.select(["bucket", "windows"]).to_pylist()}
        edge = np.zeros(len(words) + 1, np.int64)
        for bucket, distinct, index, own in groups:
            if bucket not in answers:
                continue
            per = np.fromiter((s.count(b" ") + 2 - window for s in distinct), np.int64, len(distinct))
            bits = np.unpackbits(np.frombuffer(unpack(answers[bucket]), np.uint8))
            offset = np.cumsum(per) - per
            n = per[index]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (np.repeat(first[own], n) + inner)[bits[np.repeat(offset[index], n) + inner] == 1]
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + window, minlength=len(edge))
        gone = np.cumsum(edge[:-1]) > 0
        n_words, n_removed, kept, at = [], [], [], 0
        for d in documents:
            mask = gone[at : at + len(d)]
            at += len(d)
            k = int(mask.sum())
            n_words.append(len(d))
            n_removed.append(k)
            kept.append(b" ".join([w for w, g in zip(d, mask.tolist()) if not g] if k else d).decode())  # noqa: B905
        return n_words, n_removed, kept

    return make


def drop_passages(docs: DataFrame, window: int = WINDOW, text_col: str = "text", with_text: bool = True, block_bytes: int | None = None) -> DataFrame:
    """docs with ``n_words``, ``n_removed`` and ``kept_text`` (columns of these names are replaced).

    A word goes if a window of ``window`` words of its document covers it whose sequence starts anywhere else too, in the
    same document or another; windows are judged on the input. Kept words are joined by one space. Null text has no
    words; rows that repeat each other are documents of their own; an empty table gives an empty result. A text may have
    any number of words: it is held by one task, about 100 bytes a word. ``with_text``: the text as it was, too.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    cut = blocked(docs, text_col, block_bytes=block_bytes)
    hot = docs.sparkSession.sparkContext.broadcast(hot_runs(cut, window))
    told = cut.asked(_send(window, cut.buckets, hot), SENT, _count(window), TOLD)
    return cut.applied(told, _remove(window, cut.buckets, hot), MADE, with_text)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) > 1)),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(g.gone), 0) AS k, CASE WHEN g.gone IS NULL THEN d.w ELSE list_select(d.w, list_filter(range(1, len(d.w) + 1), lambda i: NOT list_contains(g.gone, i))) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
