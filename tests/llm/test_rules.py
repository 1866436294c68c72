import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import rules


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dups += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "é ü 😀", "a a a", "a b c a b c", "x\n\nx\n x\nx", "#*$%&|<> \x85 a\xa0b", "w " * 20000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(200))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string, stats int")
    out = {r.doc_id: r.rules for r in rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, dups, repeats) = out[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), i
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    assert rules.judge(docs.limit(0)).count() == 0


def test_estimates_resist_outliers(spark):
    """A third of gross outliers leaves the centre where the rest has it, and all of them are far away."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 5)), rng.normal(12, 1, (200, 5))
    rows = [("en", "=s", x.tolist()) for x in np.vstack([good, bad])]
    got = rules.mcd(spark.createDataFrame(rows, "lang string, source string, x array<double>")).first()
    assert np.abs(np.array(got.centre)).max() < 0.3
    inverse = np.zeros((5, 5))
    k = 0
    for i in range(5):
        for j in range(i, 5):
            inverse[i, j] = inverse[j, i] = got.inverse[k]
            k += 1
    far = lambda x: np.einsum("ij,jk,ik->i", x - got.centre, inverse, x - got.centre)
    assert far(bad).min() > 5 * np.quantile(far(good), 0.99) and not math.isnan(far(bad).min())


def test_junk_goes_and_clean_stays(spark):
    out = rules.op3_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    shares = {r.quality: r.kept for r in out.where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[0] < 0.1 and shares[1] > 0.95


def prose(rng, n, lang, source, start=0):
    """Rows of clean texts: distinct words on a few lines, a small share with one symbol."""
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200))]
        words[7] += "&" if rng.random() < 0.1 else ""
        rows.append((start + i, " ".join(words[:30]) + "\n" + " ".join(words[30:]), lang, source))
    return rows


def kept(spark, rows):
    out = rules.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()
    return {r.doc_id: r.rules for r in out}


def test_copies_of_one_junk_text_in_two_fifths_of_a_group(spark):
    rng = random.Random(5)
    clean = prose(rng, 300, "en", "web")
    junk = "\n".join(["buy*** now$$$ " + " ".join(f"w{i}#" for i in range(30 * k, 30 * k + 30)) for k in range(3)])
    for share in (0.35, 0.4):
        n = int(300 * share / (1 - share))
        out = kept(spark, clean + [(1000 + i, junk, "en", "web") for i in range(n)])
        assert not any(out[1000 + i].kept for i in range(n))
        assert sum(out[i].kept for i in range(300)) >= 297


def tables(rng, n, lang, source, start):
    """Texts that are table lines throughout."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    return [(start + i, "\n".join(f"{word()} | {word()} | {word()}" for _ in range(rng.randrange(20, 50))), lang, source) for i in range(n)]


def test_a_small_source_is_judged_by_its_own(spark):
    """150 tables are what their own source holds; five in a source that is as small go by their language and are junk in it."""
    rng = random.Random(6)
    rows = sum((prose(rng, 60, "es", f"s{k}", 100 * k) for k in range(5)), []) + tables(rng, 150, "es", "tables", 1000) + tables(rng, 5, "es", "few", 2000)
    out = kept(spark, rows)
    assert all(out[1000 + i].kept for i in range(150)) and not any(out[2000 + i].kept for i in range(5))
    assert all(out[100 * k + i].kept for k in range(5) for i in range(60))


def test_a_rare_language_is_judged_too(spark):
    """Of 16 texts of a language two are junk, and one of a null language is; none is accepted for want of company."""
    rng = random.Random(7)
    rows = prose(rng, 120, "en", "a") + prose(rng, 14, "fr", None, 200) + tables(rng, 2, "fr", None, 300) + tables(rng, 1, None, None, 400) + prose(rng, 3, None, "a", 500)
    out = kept(spark, rows)
    assert not out[300].kept and not out[301].kept and not out[400].kept and None not in [r.distance for r in out.values()]
    assert all(r.kept for i, r in out.items() if not 300 <= i <= 400)


def brute_mcd(x, half=0.5, starts=200):
    """Centre and covariance (with the floors) of the half of smallest determinant, from many random starts."""
    rng, best, ridge = np.random.default_rng(1), None, np.diag(np.square(rules.FLOORS))
    h = int(np.ceil(len(x) * half))
    for _ in range(starts):
        own = x[rng.choice(len(x), 7, replace=False)]
        for _ in range(30):
            centre, cov = own.mean(0), np.cov(own.T, bias=True) + ridge
            far = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            own = x[np.argsort(far, kind="stable")[:h]]
        centre, cov = own.mean(0), np.cov(own.T, bias=True) + ridge
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], centre, cov
    return best[1:]


def test_verdicts_equal_brute_force(spark):
    """One source, a fifth of it junk of several kinds: the same texts are kept as by exhaustive concentration steps."""
    rng = random.Random(11)
    rows = prose(rng, 160, "en", "s") + tables(rng, 20, "en", "s", 1000) + [(2000 + i, "same line of text here\n" * 6 + r[1], "en", "s") for i, r in enumerate(prose(rng, 20, "en", "s"))]
    got = kept(spark, rows)
    vectors = {}
    for i, text, _, _ in rows:
        n, chars, symbols, dups, repeats = brute(text)
        lines = len([x for x in text.split("\n") if x.strip()])
        odds = math.log((dups + 1) / (lines - dups + 1)) + math.log(lines + 1)
        vectors[i] = [math.log((chars + 1) / n), math.log1p(200 * symbols / n), odds, math.log1p(20 * repeats / n), math.log(n)]
    good = [i for i in vectors if not got[i].base_failed]
    x = np.array([vectors[i] for i in good])
    centre, cov = brute_mcd(x)
    far = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    far *= rules.MEDIAN / max(np.median(far), rules.MEDIAN / 4)
    want = dict(zip(good, far <= rules.cut_for()))
    assert {i: got[i].kept for i in good} == want and 0 < sum(want.values()) < len(want)
    assert 25 < rules.cut_for(tail=1.0) < 35 and rules.cut_for(1e-3) < rules.cut_for(1e-5)
