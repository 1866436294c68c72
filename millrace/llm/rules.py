"""Quality rules: plain limits first, then robust multivariate outliers per language and source."""

from __future__ import annotations

from collections import Counter
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, small, table, written

SYMBOLS = b"#*$%&|<>"
STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Smallest standard deviation of each transformed statistic: most texts have no symbol and no repeat at all, and the
#: half of them that lies closest together would otherwise have no spread.
FLOORS = (0.05, 0.35, 0.35, 0.35, 0.7)
#: Every language and source has estimates of its own, however small; they count as size / (size + PRIOR), the rest is its
#: language's, which counts likewise against that of all texts. Estimates of so many texts are about as firm as the latter.
PRIOR = 40
#: The share of a group that the estimates rest on, and how many concentration steps lead there.
HALF, STEPS = 0.5, 5
#: Distances are scaled so that a group's median is that of chi-square with a degree of freedom for each statistic. Counts
#: of repeats and symbols have longer tails than a normal distribution: the logarithms of squared distances spread TAIL
#: times as far (from the lower quartile to the median, in each language). A clean text is rejected once in 1 / ALPHA.
MEDIAN, TAIL, ALPHA = 4.351, 2.0, 1e-5
BROADCAST_GROUPS = 50_000


def cut_for(alpha: float = ALPHA, tail: float = TAIL) -> float:
    """The squared distance beyond which a text is rejected: the quantile of chi-square (Wilson and Hilferty's), stretched by the tail."""
    d = len(FLOORS)
    quantile = d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(1 - alpha) * (2 / (9 * d)) ** 0.5) ** 3
    return MEDIAN * (quantile / MEDIAN) ** tail


def stats(text: bytes | None) -> tuple[int, ...]:
    """STATS of a text; null counts as empty. A word in several repeated 3-word windows counts once."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(set(windows)) < len(windows):
        twice = {w for w, k in Counter(windows).items() if k > 1}
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if w in twice:
                covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    return n, chars, sum(map(text.count, (b"%c" % c for c in SYMBOLS))), len(lines), len(lines) - len(set(lines)), repeated


def with_stats(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    def apply(text: pa.Array) -> pa.Array:
        rows = np.array([stats(t) for t in text.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 6)
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], STATS.names)

    return docs.drop(out_col).withColumn(out_col, F.arrow_udf(apply, STATS)(F.col(text_col)))


def vector(s: str = "stats") -> Column:
    """Mean word length, symbols a word, repeated lines and words by log odds, and length: about symmetric."""
    n, lines = F.greatest(F.col(f"{s}.n_words"), F.lit(1)), F.greatest(F.col(f"{s}.n_lines"), F.lit(1))
    odds = lambda k, of: F.log((k + 1.0) / (of - k + 1.0)) + F.log(of + 1.0)
    return F.array(F.log((F.col(f"{s}.word_chars") + 1.0) / n), F.log1p(200.0 * F.col(f"{s}.n_symbols") / n), odds(F.col(f"{s}.n_dup_lines"), lines), F.log1p(20.0 * F.col(f"{s}.n_repeat_words") / n), F.log(n.cast("double")))


def _distance(x: str, centre: str, inverse: str, d: int) -> Column:
    diff = [F.col(x)[i] - F.col(centre)[i] for i in range(d)]
    return sum((diff[i] * diff[j] * F.col(inverse)[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(combinations_with_replacement(range(d), 2))), F.lit(0.0))


def _estimates(moments: pd.DataFrame, d: int) -> pd.DataFrame:
    """Centre and inverse covariance of each group from its sums; the covariance gets the floors as a ridge."""
    pairs = list(combinations_with_replacement(range(d), 2))
    n, s, ss = moments["n"].to_numpy()[:, None], np.array(moments["s"].tolist()).reshape(-1, d), np.array(moments["ss"].tolist()).reshape(-1, len(pairs))
    mean = s / n
    cov = np.empty((len(moments), d, d))
    for k, (i, j) in enumerate(pairs):
        cov[:, i, j] = cov[:, j, i] = ss[:, k] / n[:, 0] - mean[:, i] * mean[:, j]
    cov = cov + np.diag(np.square(FLOORS[:d]))
    inverse = np.linalg.inv(cov)
    return pd.DataFrame({"lang": moments["lang"], "source": moments["source"], "start": moments["start"], "centre": mean.tolist(), "inverse": [[float(m[i, j]) for i, j in pairs] for m in inverse], "det": np.linalg.slogdet(cov)[1]})


def mcd(rows: DataFrame, steps: int = STEPS, half: float = HALF) -> DataFrame:
    """(lang, source, centre, inverse) of rows(lang, source, x): minimum-covariance-determinant estimates of each group.

    There are two starts, both from the groups' medians and median deviations: the statistics by themselves, and with the
    correlations of the directions in which texts lie from the median (spatial signs). Each step takes the closest
    ``half`` of a group by Mahalanobis distance and estimates anew from it; a step never raises the determinant. The
    start that ends with the smaller one counts. Distances are binned in 1/16 steps of
    their logarithm: one pass sums counts, vectors and products by group and bin (combined before the shuffle), and a
    group's lowest bins that hold ``half`` of it give the next estimates. No group is gathered in one place, and the
    driver sees no rows.
    """
    d = len(FLOORS)
    pairs = list(combinations_with_replacement(range(d), 2))
    keys = ["lang", "source"]
    join = lambda a, b: a.join(b.withColumnsRenamed({k: f"__{k}" for k in keys}), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__lang", "__source")
    mid_ = written(rows.groupBy(*keys).agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(d)]).alias("centre")), "median")
    spread = join(rows, small(mid_, BROADCAST_GROUPS)).groupBy(*keys).agg(F.first("centre").alias("centre"), F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("centre")[i]), 0.5, 1000) for i in range(d)]).alias("mad"))
    spread_ = written(spread, "spread")
    spread = small(spread_, BROADCAST_GROUPS)
    width = F.array(*[F.sqrt(F.pow(F.col("mad")[i] * 1.4826, 2) + FLOORS[i] ** 2) for i in range(d)])
    z = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.get("x", i) - F.get("centre", i)) / F.get("width", i))
    signs = join(rows, spread).withColumn("width", width).withColumn("z", z).withColumn("norm", F.aggregate("z", F.lit(1e-9), lambda acc, v: acc + v * v))
    signs = signs.groupBy(*keys).agg(F.first("centre").alias("centre"), F.first("width").alias("width"), F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("z")[i] * F.col("z")[j] / F.col("norm")) for i, j in pairs]).alias("ss"))
    shape = "lang string, source string, start int, centre array<double>, inverse array<double>, det double"
    now = written(signs.mapInPandas(lambda it: (_starts(x, d) for x in it if len(x)), shape), "mcd")
    schema = now.schema
    for _ in range(steps):
        placed = join(rows, small(now, BROADCAST_GROUPS)).withColumn("bin", F.floor(F.log(_distance("x", "centre", "inverse", d) + 1e-6) * 16).cast("int"))
        sums = placed.groupBy(*keys, "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}{j}") for i, j in pairs])
        by = W.partitionBy(*keys, "start")
        sums = sums.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by)).where(F.col("upto") - F.col("n") < F.col("all") * half)
        sums = sums.groupBy(*keys, "start").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{i}") for i in range(d)]).alias("s"), F.array(*[F.sum(f"p{i}{j}") for i, j in pairs]).alias("ss"))
        after = written(sums.mapInPandas(lambda it: (_estimates(x, d) for x in it if len(x)), schema), "mcd")
        forget(now)
        now = after
    forget(mid_, spread_)
    best = now.groupBy(*keys).agg(F.min_by(F.struct("centre", "inverse"), F.struct("det", "start")).alias("best"))
    return best.select(*keys, "best.*")


def _starts(groups: pd.DataFrame, d: int) -> pd.DataFrame:
    """Two starts of each group: independent statistics, and those correlated as the signs are."""
    pairs = list(combinations_with_replacement(range(d), 2))
    width, sums, out = np.array(groups["width"].tolist()).reshape(-1, d), np.array(groups["ss"].tolist()).reshape(-1, len(pairs)), []
    for start in (0, 1):
        cov = np.zeros((len(groups), d, d))
        for k, (i, j) in enumerate(pairs):
            cov[:, i, j] = cov[:, j, i] = sums[:, k] / groups["n"].to_numpy() * d if start else float(i == j)
        cov = (cov + start * 0.05 * np.eye(d)) * width[:, :, None] * width[:, None, :]
        inverse = np.linalg.inv(cov)
        out.append(pd.DataFrame({"lang": groups["lang"], "source": groups["source"], "start": start, "centre": groups["centre"], "inverse": [[float(m[i, j]) for i, j in pairs] for m in inverse], "det": np.linalg.slogdet(cov)[1]}))
    return pd.concat(out)


def _shrunk(rows: pd.DataFrame, d: int) -> pd.DataFrame:
    """Centre and inverse covariance of each source, from its own estimates (centre0...), its language's (1) and those of all texts (2)."""
    pairs = list(combinations_with_replacement(range(d), 2))
    at = [[pairs.index((min(i, j), max(i, j))) for j in range(d)] for i in range(d)]
    centre = cov = None
    for k in (2, 1, 0):
        own = np.array(rows[f"centre{k}"].tolist()).reshape(-1, d)
        spread = np.linalg.inv(np.array(rows[f"inverse{k}"].tolist()).reshape(-1, len(pairs))[:, at]) * (np.maximum(rows[f"median{k}"].to_numpy(), MEDIAN / 4) / MEDIAN)[:, None, None]
        size = rows[f"size{k}"].to_numpy().astype(float)
        w = np.ones_like(size) if centre is None else size / (size + PRIOR)
        centre = own if centre is None else w[:, None] * own + (1 - w[:, None]) * centre
        cov = spread if cov is None else w[:, None, None] * spread + (1 - w[:, None, None]) * cov
    inverse = np.linalg.inv(cov)
    return pd.DataFrame({"e_lang": rows["lang"], "e_source": rows["source"], "centre": centre.tolist(), "inverse": [[float(m[i, j]) for i, j in pairs] for m in inverse]})


def shrunk(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(e_lang, e_source, centre, inverse) of each source of rows(lang, source, x), where ``centres`` are the rows' mcd().

    Covariances are scaled so that a group's median squared distance is MEDIAN, then each source's estimates are shrunk
    to its language's, and these to those of all texts, by size (PRIOR).
    """
    d = len(FLOORS)
    group = centres.select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), "centre", "inverse")
    met = F.col("lang").eqNullSafe(F.col("e_lang")) & (F.col("source") == F.col("e_source"))
    scale = rows.join(small(group, BROADCAST_GROUPS), met).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"), F.percentile_approx(_distance("x", "centre", "inverse", d), 0.5, 1000).alias("median"))
    whole = written(scale.join(group, met).drop("e_lang", "e_source"), "scale")
    of = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("centre", "inverse", "median", "size")]
    one = whole.where("source LIKE '=%'").select("lang", "source", *of(0))
    langs = small(whole.where("source = '*'").select(F.col("lang").alias("l_lang"), *of(1)), BROADCAST_GROUPS)
    full = one.join(langs, F.col("lang").eqNullSafe(F.col("l_lang"))).drop("l_lang").crossJoin(F.broadcast(whole.where("source = '**'").select(*of(2))))
    return full.mapInPandas(lambda it: (_shrunk(x, d) for x in it if len(x)), "e_lang string, e_source string, centre array<double>, inverse array<double>")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out_col: str = "rules", cut: float | None = None) -> DataFrame:
    """docs without their text, with ``out_col``: (stats..., base_failed, distance, kept). Replaces a column of that name.

    A text fails the base rules with fewer than MIN_WORDS words or with more than MAX_REPEAT_PERCENT of them in
    repeated 3-word windows. All that pass give the estimates of their language and source, shrunk by size as shrunk()
    says, and are kept unless their squared distance, on a scale on which a group's median is MEDIAN, is above ``cut`` (cut_for()).
    Null language and source are values of their own. Only texts of a source of which none passes have no distance.
    Null text is empty; an empty table gives an empty result.
    """
    d, cut = len(FLOORS), cut_for() if cut is None else cut
    plain = with_stats(docs.select(*[F.col(c).alias(f"c__{c}") for c in docs.columns if c not in (text_col, out_col)], F.col(text_col).alias("__text")), "__text", "stats").drop("__text")
    s = lambda n: F.col(f"stats.{n}")
    plain = plain.withColumn("base_failed", (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEAT_PERCENT * s("n_words"))).withColumn("x", vector())
    plain = written(plain.withColumnsRenamed({f"c__{lang_col}": "lang", f"c__{source_col}": "source"}), "stats")
    good = plain.where(~F.col("base_failed"))
    # each text counts in three groups: its source's ("=" in front), its language's ("*") and that of all texts ("**")
    own = F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    levels = F.array(F.struct("lang", own.alias("source")), F.struct("lang", F.lit("*").alias("source")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit("**").alias("source")))
    grouped = good.select(F.explode(levels).alias("g"), "x").select("g.*", "x")
    group = small(written(shrunk(grouped, mcd(grouped)), "shrunk"), BROADCAST_GROUPS)
    out = plain.withColumn("g", own).join(group, F.col("lang").eqNullSafe(F.col("e_lang")) & (F.col("g") == F.col("e_source")), "left")
    distance = _distance("x", "centre", "inverse", d)
    kept = ~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))
    rules = F.struct("stats.*", "base_failed", distance.alias("distance"), kept.alias("kept"))
    names = [F.col({lang_col: "lang", source_col: "source"}.get(c, f"c__{c}")).alias(c) for c in docs.columns if c not in (text_col, out_col)]
    return out.select(*names, rules.alias(out_col))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *[f"rules.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")])
