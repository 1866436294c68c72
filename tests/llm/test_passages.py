import hashlib
import random
from collections import Counter

import numpy as np

from millrace.llm import passages
from millrace.llm.passages import drop_passages, op2_passages, repeated


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def got(spark, rows, window, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in drop_passages(df, window, **more).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "ü", "dd", "e.", "F"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(None, None), (1, ""), (2, " \t\n "), (3, "a " * 500), (4, "a\x0bb\x85c d")]
    for i in range(10, 60):
        own = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))
        rows.append((i, own + "\n" + (passage if i % 3 else "") + " " + own[:50]))
    rows += [rows[-1], (99, rows[-1][1])]
    for window in (35, 8, 3):
        assert got(spark, rows, window) == brute(rows, window), window


def test_driver_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 35)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op2_passages(spark, "/root/testdata/sf0.01").collect()) == sorted(want)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, "z")], "doc_id long, text string, n_words int, block int, kept_text string")
    assert drop_passages(df).first().asDict() == {"doc_id": 1, "text": "a b", "block": 6, "n_words": 2, "n_removed": 0, "kept_text": "a b"}
    assert drop_passages(df.limit(0)).count() == 0


def test_equal_hashes_are_compared_by_words(monkeypatch):
    from millrace.llm import passages

    monkeypatch.setattr(passages, "mix", lambda x: x * passages.U(0))
    ids = np.array([1, 2, 3, 1, 2, 4], np.int32)
    assert repeated(ids, np.array([0, 1, 2, 3, 4]), np.array([1, 1, 1, 1, 1]), 2).tolist() == [True, False, False, True, False]


def test_many_blocks_and_copies(spark):
    """Texts that stand for many rows, in blocks of their own, meet the others' windows."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    one = " ".join(rng.choice(words) for _ in range(90))
    rows = [(i, one) for i in range(60)] + [(100, one[30:] + " x " + one[:-40])] + [(200, "short")] * 80 + [(300 + i, None) for i in range(60)]
    rows += [(400 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(70)))) for i in range(60)]
    for window in (35, 5):
        assert got(spark, rows, window, block_bytes=3000) == brute(rows, window)


def windows(documents, window, hot=None):
    """(bucket, first window) of each window, and the packed runs' ends are the same ones."""
    words, first, last, bucket = passages.super_kmers(documents, window, 1 << 20, hot)
    return {at: int(b) for f, e, b in zip(first, last, bucket) for at in range(f, e + 1)}


def test_chunks_and_hot_runs_only_deal_differently(monkeypatch):
    rng = random.Random(2)
    documents = [[rng.choice("abcd").encode() for _ in range(rng.randrange(200))] for _ in range(20)]
    whole = windows(documents, 12)
    monkeypatch.setattr(passages, "CHUNK", 50)
    assert windows(documents, 12) == whole
    flat = [w for d in documents for w in d]
    keys, times = np.unique(passages.hashed_runs(flat, passages.MINIMISER), return_counts=True)
    hot = keys[times >= 3]
    dealt = windows(documents, 12, hot)
    assert set(dealt) == set(whole) and dealt != whole
    seen = {}
    for at, bucket in dealt.items():  # equal windows still meet
        assert seen.setdefault(tuple(flat[at : at + 12]), bucket) == bucket


def test_a_text_of_more_than_2_to_the_24_words():
    n = (1 << 24) + 1000
    text = [b"%d" % (i % 977) for i in range(9770)] * (n // 9770 + 1)
    words, first, last, _ = passages.super_kmers([text[:n]], 35, 64)
    assert len(words) == n and first[0] == 0 and last[-1] == n - 35 and (first[1:] == last[:-1] + 1).all()
