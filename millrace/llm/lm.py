"""LM scoring: a weighted backoff automaton of smoothed n-grams, traversed once from left to right."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from .common import table, written
from .exchange import Documents, blocked, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from .shingles import PLACES, U, mix

#: How many tokens a context's lower order counts as, for contexts of one and of two words (chosen on held-out texts).
PRIOR = (0.0, 300.0, 30.0)
#: Words are known by 64-bit hashes; the end of a text is one, its beginning a context only.
BEGIN, END = U(1), U(2)
#: Tokens of a stretch: a block's stretches are traversed side by side.
STRETCH = 512

SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
TOLD = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("v", T.LongType())])


def gram(*words: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams; odd for single tokens, so that a bucket can tell them, even for all others."""
    key = np.full(len(words[0]), len(words), U) * PLACES[-1]
    for w, place in zip(words, PLACES[: len(words)], strict=True):
        key = key + w * place
    key = mix(key) & ~U(1)
    return key | (words[0] != BEGIN).astype(U) if len(words) == 1 else key


class Block:
    """The n-grams of some texts up to three tokens: distinct keys in order, and each token's places among them."""

    def __init__(self, documents: list[list[bytes]], times: np.ndarray):
        """``times``: how often each document counts for training."""
        sizes = np.array([len(d) + 1 for d in documents], np.int64)
        words = pa.array([w for d in documents for w in d], pa.binary()).dictionary_encode()
        known = np.fromiter((xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), U, len(words.dictionary))
        self.starts = np.cumsum(sizes) - sizes
        token = np.full(int(sizes.sum()), END, U)
        inner = np.ones(len(token), bool)
        inner[self.starts + sizes - 1] = False
        token[inner] = known[words.indices.to_numpy()] if len(known) else np.zeros(0, U)
        first = np.zeros(len(token), bool)
        first[self.starts] = True
        before = np.concatenate([[BEGIN], token[:-1]])
        before[self.starts] = BEGIN
        # a text's first token has one word of context only, the beginning
        third = np.flatnonzero(~first)
        one, two = gram(token), gram(before, token)
        three = gram(before[third - 1], before[third], token[third])
        n, grams = len(token), np.concatenate([one, two, three, gram(np.array([BEGIN]))])
        del words, token, before, one, two, three  # a block's arrays are what a task's memory goes to
        self.keys, place = np.unique(grams, return_inverse=True)
        place = place.astype(np.int32)
        self.uni, self.bi, self.begin = place[:n], place[n : 2 * n], place[-1]
        self.tri = np.full(n, -1, np.int32)
        self.tri[third] = place[2 * n : -1]
        self.context = np.concatenate([np.zeros(1, np.int32), self.uni[:-1]])
        self.context[self.starts] = self.begin
        weight = np.repeat(np.asarray(times, np.int64), sizes)
        counted = [self.uni, self.bi, self.tri[third], [self.begin]]
        self.counts = sum(np.bincount(p, w, len(self.keys)) for p, w in zip(counted, (weight, weight, weight[third], [np.sum(times)]), strict=True)).astype(np.int64)

    def cuts(self, n: int) -> np.ndarray:
        """Where the keys of each of n buckets, even shares of all 64-bit numbers, begin; their number last."""
        return np.concatenate([np.searchsorted(self.keys, np.array([(b << 64) // n for b in range(n)], U)), [len(self.keys)]])


def _send(n: int):
    def apply(rows: pa.Table) -> pa.Table:
        documents = Documents(rows)
        b = Block([t.lower().split() for t in documents.texts], documents.column("__train").to_numpy())
        cuts = b.cuts(n)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        out = [{"bucket": k, "block": documents.number, "keys": pack_sorted(b.keys[cuts[k] : cuts[k + 1]]), "counts": pack_numbers(b.counts[cuts[k] : cuts[k + 1]])} for k in full.tolist()]
        return pa.Table.from_pylist(out, to_arrow_schema(SENT))

    return apply


def _answer(bucket: pa.Table) -> pa.Table:
    """Sums of a bucket's keys for each block, and of all: its training tokens (n) and how many distinct ones (v)."""
    rows = bucket.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate([unpack_numbers(r["counts"]) for r in rows]))
    tokens = total[known & U(1) == 1]
    out = [{"block": -1, "bucket": rows[0]["bucket"], "n": int(tokens.sum()), "v": int((tokens > 0).sum())}]
    ends = np.cumsum([len(k) for k in keys])
    out += [{"block": r["block"], "bucket": r["bucket"], "counts": pack_numbers(total[p])} for r, p in zip(rows, np.split(place, ends[:-1]), strict=True)]
    return pa.Table.from_pylist(out, to_arrow_schema(TOLD))


@dataclass
class Automaton:
    """The part of the automaton that a block's texts need, laid out by token.

    States are the contexts that training has: two tokens (order 2), one (order 1), none (the root). ``arcs[k]`` is the
    log10 weight of a token's arc out of its context of order k, NaN where training has not seen it there; the root has
    an arc for every token. ``fails[k]`` is the weight of that context's failure arc, to its longest proper suffix,
    and ``after`` the order of the longest suffix of what has been read, the token included, that is a state.
    """

    arcs: list[np.ndarray]
    fails: list[np.ndarray]
    after: np.ndarray


def build(b: Block, counts: np.ndarray, n: int, v: int) -> Automaton:
    """Smoothed weights: a context's counts, with PRIOR tokens more that are spread as the next lower order has them.

    So an arc weighs (count + PRIOR * weight one order lower) / (count of the context + PRIOR), a failure arc PRIOR /
    (count of the context + PRIOR), and the weights out of each state sum to 1. The root's are the base's.
    """
    root = (counts[b.uni] + 0.5) / (n + 0.5 * (v + 1))
    one, two = counts[b.context], np.where(b.tri >= 0, counts[np.concatenate([np.zeros(1, np.int32), b.bi[:-1]])], 0)
    seen2, seen3 = counts[b.bi], np.where(b.tri >= 0, counts[b.tri], 0)
    second = (seen2 + PRIOR[1] * root) / (one + PRIOR[1])
    third = (seen3 + PRIOR[2] * second) / (two + PRIOR[2])
    arcs = [np.log10(root), np.where(seen2 > 0, np.log10(second), np.nan), np.where(seen3 > 0, np.log10(third), np.nan)]
    fails = [np.zeros(0), np.log10(PRIOR[1] / (one + PRIOR[1])), np.log10(PRIOR[2] / (two + PRIOR[2]))]
    return Automaton(arcs, fails, np.where(counts[b.bi] > 0, 2, np.where(counts[b.uni] > 0, 1, 0)))


def traverse(a: Automaton, starts: np.ndarray, begun: bool, stretch: int = STRETCH) -> np.ndarray:
    """The texts' log10 probabilities: from left to right, each token along an arc, after as many failure arcs as it takes.

    All texts go at once, those longer than ``stretch`` in stretches: the state that a stretch begins in is the longest
    suffix read before it, which the two tokens before it tell. A text begins after the beginning (order 1, if
    training has any), a state of its own.
    """
    n = len(a.after)
    heads = np.unique(np.concatenate([starts, *(np.arange(s, e, stretch) for s, e in zip(starts, np.append(starts[1:], n), strict=True) if e - s > stretch)]))
    lengths = np.diff(np.append(heads, n))
    order = np.argsort(-lengths, kind="stable")
    at, left = heads[order], lengths[order]
    state = np.where(np.isin(at, starts), int(begun), a.after[at - 1])
    log = np.zeros(len(at))
    for step in range(int(left[0]) if len(left) else 0):
        live = np.searchsorted(-left, -step, "left")  # stretches longer than step
        t, s = at[:live] + step, state[:live].copy()
        gain = np.zeros(live)
        for k in (2, 1):
            stuck = (s == k) & np.isnan(a.arcs[k][t])
            gain[stuck] += a.fails[k][t[stuck]]
            s[stuck] = k - 1
        gain += np.where(s == 2, a.arcs[2][t], np.where(s == 1, a.arcs[1][t], a.arcs[0][t]))
        log[:live] += gain
        state[:live] = a.after[t]
    whole = np.zeros(len(at))
    whole[order] = log
    return np.add.reduceat(whole, np.searchsorted(heads, starts)) if len(starts) else whole


SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _score(n_buckets: int, n: int, v: int):
    def make(documents: Documents, told: pa.Table) -> tuple[np.ndarray, ...]:
        b = Block([t.lower().split() for t in documents.texts], documents.column("__train").to_numpy())
        counts, cuts = np.zeros(len(b.keys), np.int64), b.cuts(n_buckets)
        for r in told.to_pylist():
            counts[cuts[r["bucket"]] : cuts[r["bucket"] + 1]] = unpack_numbers(r["counts"])
        automaton = build(b, counts, n, v)
        known, base = (np.add.reduceat(x, b.starts) for x in ((counts[b.uni] > 0).astype(np.int64), automaton.arcs[0]))
        sizes = np.diff(np.append(b.starts, len(b.uni)))
        return sizes, known, np.full(len(sizes), n), base, traverse(automaton, b.starts, counts[b.begin] > 0)

    return make


def score(docs: DataFrame, train: Callable[[], Column] | Column, text_col: str = "text", with_text: bool = True, block_bytes: int | None = None) -> DataFrame:
    """docs with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (columns of these names are replaced).

    The model is counted over all documents for which ``train`` holds (null: not). Tokens are the words, lower-cased in
    A-Z, then one end. base_score sums log10 of additively smoothed unigrams, score those of the automaton of
    n-grams up to three tokens, see build() and traverse(). Blocks send their n-grams, by 64-bit keys, to the keys'
    buckets, which count them over all blocks and answer with the counts; a block's automaton has the states and arcs
    its own texts need, so no model is ever broadcast and no n-gram is dropped. Null text is empty: one token, the end.
    Repeated rows count each. An empty table gives an empty result. ``with_text``: the text, too.
    """
    docs = docs.drop(*SCORES.names)
    cut = blocked(docs.withColumn("__is_train", F.coalesce(train, F.lit(False))), text_col, "__is_train", block_bytes)
    told = written(cut.asked(_send(cut.buckets), SENT, _answer, TOLD), "counts")
    n, v = told.where("block < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return cut.applied(told.where("block >= 0").drop("n", "v"), _score(cut.buckets, n, v), SCORES, with_text)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = score(docs.withColumn("held_out", held), ~F.col("held_out"), with_text=False)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
