import random

from millrace.llm.leaks import drop_leaks, find_leaks


def shingle_set(text):
    w = (text or "").lower().encode().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, percent):
    out = set()
    for d, t in docs:
        s = shingle_set(t)
        for i, u in items:
            v = shingle_set(u)
            if v and 100 * len(s & v) >= percent * len(v):
                out.add((d, i, len(v), len(s & v)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)] + ["É", "é"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 12, 20, 33, 64, 65, 100, 300])]
    docs = [(None, None), (1, ""), (2, " "), (None, " ".join(items[7][1]).upper())]
    for i in range(60):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = rng.choice(words)
        docs.append((10 + i, " ".join(text(rng.randrange(0, 400)) + part + text(rng.randrange(0, 100)))))
    docs += [(200 + i, "\t".join(items[i][1])) for i in range(5)] * 2
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, " ".join(items[8][1]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for percent in (80, 100, 50):
        got = sorted((tuple(r) for r in find_leaks(d, b, percent).collect()), key=str)
        assert got == brute(docs, items, percent)
    leaking = {x[0] for x in brute(docs, items, 80)}
    assert sorted(str(r.doc_id) for r in drop_leaks(d, b).collect()) == sorted(str(i) for i, _ in docs if i not in leaking)


def test_empty_tables_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 1, "x", [1])], "doc_id long, text string, item long, w string, h array<int>")
    b = spark.createDataFrame([(7, "a b c d e f", "x")], "item_id long, text string, id string")
    assert [tuple(r) for r in find_leaks(d, b).collect()] == [(1, 7, 2, 2)]
    assert find_leaks(d, b.limit(0)).count() == find_leaks(d.limit(0), b).count() == 0
    assert drop_leaks(d, b).columns == d.columns
