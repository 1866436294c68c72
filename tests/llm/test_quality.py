import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality


def test_held_out_accuracy(spark):
    """Fitted on every other label, it finds what the other labels reject and leaves the rest alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = labels.join(docs, "doc_id").select("doc_id", "text", quality.graded(labels).alias("grade")).collect()
    rows.sort(key=lambda r: r.doc_id)
    sets = [np.array(sorted(quality.features(r.text.encode())), np.int32) for r in rows]
    weights, cuts = quality.fit(sets[::2], [r.grade for r in rows[::2]])
    assert (np.diff(cuts) > 0).all()
    top = [cuts[-1] <= weights[s].sum() for s in sets[1::2]]
    good = [t for t, r in zip(top, rows[1::2]) if r.grade == 2]
    bad = [t for t, r in zip(top, rows[1::2]) if r.grade < 2]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_fit_is_the_penalised_optimum():
    """No small step from the fitted weights and thresholds raises the penalised likelihood, computed row by row."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.choice(30, rng.integers(1, 8))).astype(np.int32) for _ in range(120)]
    grades = [int(2 - (3 in r) - (4 in r or 5 in r)) if rng.random() < 0.8 else int(rng.integers(3)) for r in rows]
    z, prior, power, decay = 3.5, 2.0, 3.0, 0.1
    weights, cuts = quality.fit(rows, grades, steps=3000, decay=decay)
    rate = np.mean([g < 2 for g in grades])
    ease = []
    for k in range(30):
        n, bad = sum(k in r for r in rows), sum(k in r and g < 2 for r, g in zip(rows, grades))
        ease.append(min(abs(bad - n * rate) / (z * math.sqrt((n + prior) * rate * (1 - rate))), 1) ** power)
    ease = np.array(ease)

    def value(own, cut):
        out = -decay / 2 * (own**2).sum()
        for r, g in zip(rows, grades):
            s = sum(ease[k] * own[k] for k in r)
            below = [0, *(1 / (1 + math.exp(s - c)) for c in cut), 1]
            out += math.log(below[g + 1] - below[g])
        return out

    own = np.where(ease > quality.LEAST, weights[:30] / np.where(ease > 0, ease, 1), 0)
    best = value(own, cuts)
    for _ in range(200):
        assert value(own + rng.normal(0, 0.05, 30) * (ease > quality.LEAST), cuts + rng.normal(0, 0.02, 2)) <= best + 1e-3
    assert min(own) < 0 < max(own) and weights[3] < 0


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weights, cuts = quality.train(docs, labels, quality.graded(labels))
    for r in quality.score(docs, (weights, cuts)).collect():
        s = sum(weights[k] for k in quality.features((r.text or "").encode()))
        above = [1 / (1 + math.exp(c - s)) for c in cuts]
        assert abs(r.quality.p_top - above[-1]) < 1e-4 and abs(r.quality.expected_grade - sum(above)) < 1e-4


def test_scores_rank_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = quality.score(docs, quality.train(docs, labels, quality.graded(labels))).select("quality.expected_grade").toPandas()["expected_grade"]
    assert len(set(out.quantile([0.1, 0.25, 0.5, 0.75, 0.9]).round(9))) == 5


def test_copies_of_a_labelled_text_are_collected_once(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 500 + [(2, "x y z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    once = quality.train(docs.dropDuplicates(), labels, quality.graded(labels))
    model = quality.train(docs, labels, quality.graded(labels))
    assert all((a == b).all() for a, b in zip(once, model))


def test_probabilities_are_ordered_and_rerun_agrees(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c " * 50, 0.5), (3, "a b c " * 50, 0.5), (None, "é" * 20000, 0.5)], "doc_id long, text string, quality double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    runs = []
    for _ in range(2):
        model = quality.train(docs, labels, quality.graded(labels))
        out = quality.score(docs, model)
        assert out.columns == ["doc_id", "text", "quality"]
        runs.append(sorted(str(r.quality) for r in out.collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 5
    assert out.where("quality.p_top > quality.expected_grade").count() == 0


def test_no_labels_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels, quality.graded(labels)))
    assert out.where(F.col("quality.p_top") >= quality.KEEP).count() == 2
    assert quality.score(docs.limit(0), quality.fit([], [])).count() == 0


def test_rare_languages_and_grades_are_rejected(spark):
    """With few labels too, most toxic and most low-quality documents of each language go, and the good ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = quality.score(docs, quality.train(docs, labels, quality.graded(labels))).withColumnRenamed("quality", "score").join(labels, "doc_id")
    kinds = {"toxic": F.col("toxic") == 1, "low": F.col("quality") == 0, "good": (F.col("quality") == 1) & (F.col("toxic") == 0)}
    shares = [F.avg(F.when(holds, (F.col("score.p_top") >= quality.KEEP).cast("int"))).alias(kind) for kind, holds in kinds.items()]
    rows = out.groupBy("lang").agg(*shares).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.toxic <= 0.3 and r.low <= 0.3 and r.good >= 0.98, r


def test_a_fit_holds_few_copies_of_its_entries():
    """Beside the rows, the fit needs little more than its tables of slots: not 30 bytes for each of 4.8 million entries."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 1 << quality.BITS, 1200)).astype(np.int32) for _ in range(4000)]
    grades = rng.integers(0, 3, 4000).tolist()
    tracemalloc.start()
    quality.fit(rows, grades, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6


def test_labelled_texts_reach_the_driver_in_parts(spark, monkeypatch):
    """The rows of the fit are not collected at once."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes = []
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(self) or [])
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    weights, _ = quality.train(docs, labels, quality.graded(labels))
    assert not sizes and (weights != 0).any()
