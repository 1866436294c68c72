import math
import random
import zlib
from collections import Counter

import numpy as np
from millrace.llm import lm
from millrace.llm.lm import PRIOR, op4_lm, score
from pyspark.sql import functions as F


def model(docs):
    """(weight of a token after a context of up to two, words, tokens, distinct tokens) of training texts, token by token."""
    count, after = Counter(), Counter()
    for t in docs:
        padded = [0, *t]
        for i, w in enumerate(t, 1):
            for size in range(min(i, 2) + 1):
                context = tuple(padded[i - size : i])
                count[*context, w] += 1
                after[context] += 1
    n, v = after[()], sum(len(k) == 1 for k in count)

    def weight(context, w):
        if not context:
            return (count[w,] + 0.5) / (n + 0.5 * (v + 1))
        m = PRIOR[len(context)]
        return (count[*context, w] + m * weight(context[1:], w)) / (after[context] + m)

    return weight, count, n, v


def brute(rows, train):
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    weight, count, n, _ = model([t for i, t in docs if train(i)])
    out = []
    for i, t in docs:
        padded, base, total = [0, *t], 0.0, 0.0
        for k, w in enumerate(t, 1):
            base += math.log10(weight((), w))
            total += math.log10(weight(tuple(padded[max(k - 2, 0) : k]), w))
        out.append((str(i), len(t), sum(count[w,] > 0 for w in t), n, base, total))
    return sorted(out)


def test_weights_out_of_each_state_sum_to_one():
    rng = random.Random(4)
    docs = [[rng.choice("abcd").encode() for _ in range(rng.randrange(6))] + [None] for _ in range(12)]
    weight, count, _, _ = model(docs)
    tokens = [b"a", b"b", b"c", b"d", None, b"unknown"]
    for context in [(), (0,), (b"a",), (b"unknown",), (0, b"a"), (b"a", b"b"), (b"d", b"unknown")]:
        assert abs(sum(weight(context, w) for w in tokens) - 1) < 1e-12
    assert count[b"unknown",] == 0


def test_traversal_walks_arcs_and_failure_arcs():
    """Stretches of any length give what a walk token by token gives: an arc, or failure arcs until there is one."""
    rng = random.Random(8)
    docs = [[rng.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(rng.randrange(80))] for _ in range(30)]
    times = np.array([i % 3 > 0 for i in range(30)], int)
    b = lm.Block(docs, times)
    tokens = b.counts[b.keys & np.uint64(1) == 1]
    a = lm.build(b, b.counts, int(tokens.sum()), int((tokens > 0).sum()))
    want = []
    for start, end in zip(b.starts, [*b.starts[1:], len(a.after)]):
        state, total = 1, 0.0
        for t in range(start, end):
            while np.isnan(a.arcs[state][t]):
                total += a.fails[state][t]
                state -= 1
            total += a.arcs[state][t]
            state = a.after[t]
        want.append(total)
    for stretch in (1, 7, 512):
        assert np.allclose(lm.traverse(a, b.starts, True, stretch), want)
    assert {0, 1, 2} == set(a.after.tolist()) | {0}


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), want):
        assert a[:4] == b[:4] and all(abs(x - y) < 1e-6 * max(1, abs(y)) for x, y in zip(a[4:], b[4:])), (a, b)


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in op4_lm(spark, "/root/testdata/sf0.001").collect()]
    same(got, brute(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1))


def test_nulls_repeats_empty_and_clashes(spark):
    rows = [(None, None), (1, ""), (2, "A a b"), (2, "A a b"), (3, "c\x0bÉ é d"), (4, "a b " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, block string")
    out = score(df, F.col("doc_id") != 3)
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()]
    same(got, brute(rows, lambda i: i is not None and i != 3))
    assert score(df.limit(0), F.lit(True)).count() == 0
    assert score(df, F.lit(False)).where("n_known = 0 AND train_tokens = 0").count() == 6


def test_many_blocks_and_copies(spark):
    """Copies that stand apart count as the rows they are, in and out of training."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(1000 + i, "one text of many rows " * 20) for i in range(150)] + [(5, rows[5][1])] * 40
    out = score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 1, block_bytes=4000)
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()]
    same(got, brute(rows, lambda i: i % 4 != 1))
