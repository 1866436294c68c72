"""Each stage against plain Python on the smallest tables; the stages' own tests cover their methods."""

from collections import Counter

import corpus_pipeline
from millrace.llm import lines, near, quality
from tests.llm.test_leaks import brute as leaking
from tests.llm.test_lines import brute as deduped
from tests.llm.test_near import brute as grouped

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        texts = [(i, r.text) for i, r in sorted(before.items())]
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
            kept = {r.doc_id for r in rows}
            assert all(before[r.doc_id] == r for r in rows) and len(good & kept) >= 0.95 * len(good)
        elif name == "lines":
            want = {i: t for i, n, d, _, t in deduped(texts, 1, lines.MIN_CHARS) if n == 0 or d < n}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near":
            want = {i for i, (_, c) in grouped(texts, 80).items() if i == c}
            assert {r.doc_id for r in rows} == want
        elif name == "leaks":
            assert {r.doc_id for r in rows} == set(before) - {x[0] for x in leaking(texts, items, 80)}
        else:
            taken, targets = Counter(), {}
            for r in rows:
                taken[r.source] += r.size
                targets[r.source] = r.target
            total = sum(len(r.text.encode().split()) for r in before.values())
            assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total and max(r.repetition for r in rows) <= 2
            continue
        assert out.columns == columns
        docs = spark.createDataFrame(rows, docs.schema) if rows else docs.limit(0)
        before = {r.doc_id: r for r in rows}
    assert quality.KEEP and near.ROWS
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, rows))
