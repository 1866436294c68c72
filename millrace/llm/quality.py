"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, table, written

BITS = 20
#: Besides whole words, their first so many bytes are features: inflected forms share them.
PREFIXES = (4, 5, 6, 7)
#: At most so many labelled documents, those whose ids hash lowest, are used to fit; every document is scored.
MAX_LABELLED = 10_000
#: A document is kept if it has the top grade with at least this probability.
KEEP = 0.5
#: Slots whose weights would be shrunk to less than this have none: held-out results are the same, in half the time.
LEAST = 0.01
#: Entries of the labelled documents that the fit handles at once.
CHUNK = 1 << 20
#: The labelled documents' entries reach the driver in so many parts, one after the other.
PARTS = 16

SCORE = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])


MASK = (1 << BITS) - 1
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _slot(name: bytes) -> int:
    return crc32(name) & MASK


@lru_cache(1 << 16)
def _word(w: bytes) -> tuple[int, ...]:
    """Slots of the word without its case and outer punctuation, and of its prefixes; last a number for its shape."""
    core = w.lower().strip(EDGE) or w
    slots = [crc32(core, 1)]
    slots += [crc32(core[:n]) for n in PREFIXES if n < len(core)]
    shape = (w.isupper() and len(core) > 1) | w.islower() << 1 | w.isalpha() << 2 | (w[-1] << 3 if w[-1] in EDGE else 0) | (w[0] in EDGE) << 11 | (len(w) > 1 and w[-1] == w[-2]) << 12
    return (*[x & MASK for x in slots], shape)


def features(text: bytes | None) -> set[int]:
    """Slots of the distinct words and prefixes, of each shape that 1/16 of the words or more have, with its share to a power of two, and of how often words recur."""
    counts = Counter((text or b"").split())
    slots, shapes = set(), Counter()
    for w, n in counts.items():
        *own, shape = _word(w)
        slots.update(own)
        shapes[shape] += n
    total = sum(shapes.values())
    for shape, n in shapes.items():
        if 16 * n >= total:
            slots.add(_slot(b"s:%d:%d" % ((total // n).bit_length(), shape)))
    if total >= 20:
        slots.add(_slot(b"r:%d" % (20 * len(counts) // total)))
    return slots


def _runs(rows: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, rows) of runs of rows with about CHUNK entries."""
    first, total = 0, 0
    for i, r in enumerate(rows, 1):
        total += len(r)
        if total >= CHUNK or i == len(rows):
            yield first, rows[first:i]
            first, total = i, 0


def fit(rows: list[np.ndarray], grades: list[int], n_grades: int = 3, steps: int = 250, decay: float = 0.1, prior: float = 2.0, z: float = 3.5, power: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade <= k) = logistic(thresholds[k] - sum of weights), by penalised likelihood.

    Slots take part however rare they are, whether it misses the top grade more or less often than all rows. The penalty
    does the shrinking: the less a slot's difference is against ``z`` standard errors (of ``prior`` rows more than have
    it), the larger, so that rare slots count where no clearer ones explain a grade.

    Ordered thresholds are a first one plus exponentials. Without rows everything gets the top grade.
    """
    weights = np.zeros(1 << BITS)
    if not rows:
        return weights, np.arange(n_grades - 1) - 50.0
    y = np.asarray(grades)
    below = y < n_grades - 1
    rate = np.clip(below.mean(), 1e-3, 1 - 1e-3)
    # by chunks: besides the rows and, four bytes each, slot and owner of the entries that take part, the driver never holds more than CHUNK entries
    n, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for first, run in _runs(rows):
        n += np.bincount(np.concatenate(run), minlength=1 << BITS)
        bad += np.bincount(np.concatenate([r for r, ill in zip(run, below[first:]) if ill] or [run[0][:0]]), minlength=1 << BITS)  # noqa: B905
    ease = np.clip(np.abs(bad - n * rate) / (z * np.sqrt((n + prior) * rate * (1 - rate))), 0, 1) ** power
    used = np.flatnonzero(ease > LEAST)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    chunks = []
    for first, run in _runs(rows):
        at = place[np.concatenate(run)]
        owner = np.repeat(np.arange(first, first + len(run), dtype=np.int32), [len(r) for r in run])
        chunks.append((at[at >= 0], owner[at >= 0]))
    ease = ease[used]
    share = np.clip(np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / len(y), 1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(n_grades - 1))
    par = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        own, raw = par[: len(used)], par[len(used) :]
        w = ease * own
        cuts = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]), [np.inf]])
        s = sum((np.bincount(owner, w[at], minlength=len(rows)) for at, owner in chunks), np.zeros(len(rows)))
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(s - cuts[y + 1])), 1 / (1 + np.exp(s - cuts[y]))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dcut = np.bincount(y, dhi, minlength=n_grades)[:-1] - np.bincount(y, dlo, minlength=n_grades)[1:]
        tails = np.cumsum(dcut[::-1])[::-1]
        pull = sum((np.bincount(at, (dlo - dhi)[owner], minlength=len(used)) for at, owner in chunks), np.zeros(len(used)))
        grad = np.concatenate([pull * ease - decay * own, tails[:1], tails[1:] * np.exp(raw[1:])]) / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        par = par + 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = ease * par[: len(used)]
    raw = par[len(used) :]
    return weights, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """fit() over at most ``most`` labelled documents; null ids and grades are left out, equal texts of a grade count once."""
    extract = F.arrow_udf(lambda text: pa.array([np.array(sorted(features(t)), np.int32).tobytes() for t in text.cast(pa.binary()).to_pylist()], pa.binary()), T.BinaryType())
    chosen = labels.select(F.col(id_col).alias("__id"), grade.cast("int").alias("grade")).dropna().orderBy(F.xxhash64("__id"), "grade").limit(most)
    got = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(extract(text_col).alias("f"), "grade")
    # copies count once, before anything is sent; of an id with many texts no more than ``most`` rows in all come, in parts, for the driver's memory
    once = written(got.distinct().orderBy(F.xxhash64("f"), "grade").limit(most).repartition(PARTS), "labelled")
    rows = sorted((bytes(r.f), r.grade) for r in once.toLocalIterator())
    forget(once)
    return fit([np.frombuffer(f, np.int32) for f, _ in rows], [g for _, g in rows], n_grades)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """docs with ``out_col``: (expected_grade, p_top), of the whole text; null counts as empty. Replaces a column of that name."""
    weights, cuts = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    def apply(text: pa.Array) -> pa.Array:
        w = weights.value
        s = np.array([float(w[np.fromiter(features(t), np.int64)].sum()) for t in text.cast(pa.binary()).to_pylist()])
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -500, 500)))
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, -1])], ["expected_grade", "p_top"])

    return docs.drop(out_col).withColumn(out_col, F.arrow_udf(apply, SCORE)(F.col(text_col)))


def graded(labels: DataFrame) -> Column:
    """2 for documents of good quality that are not toxic, 1 if one of the two fails, 0 if both; null if either is."""
    return labels["quality"].cast("int") + 1 - labels["toxic"].cast("int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), train(docs, labels, graded(labels)))
    return out.select("doc_id", "quality.expected_grade", "quality.p_top", (F.col("quality.p_top") >= KEEP).alias("kept"))
