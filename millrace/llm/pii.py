"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Possessive repeats scan a run once, and a start inside a run that already failed is not tried again, so the cost
# stays linear in the text. \G stands for a start right behind the match before.
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: The runs of digits with single separators that have 13 to 19 digits; shorter and longer runs never pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"

BEFORE, AFTER = 48, 16
BOOST, THRESHOLD = 0.35, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """True if the account number's letters and digits, its first four moved behind, leave 1 when divided by 97."""
    s = F.regexp_replace(m, r"\x20", "")
    chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4)), "")
    step = lambda acc, c: F.when(c >= "A", acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(chars, F.lit(0), lambda acc, c: step(acc, c).cast("int")) == 1


#: kind: pattern, a cheap test of the text, what confirms a match, score before context, context words. In this order.
KINDS = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, r"\b(e-?mail|mail|contact|write)\b"),
    "ip": (IP, None, lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255), 0.6, r"\b(ip|address|host|server|client)\b"),
    "card": (CARD, None, lambda m: F.call_function("luhn_check", _digits(m)), 0.7, r"\b(card|visa|credit|debit|mastercard|amex|cvv)\b"),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.6, r"\b(phone|tel|call|mobile|fax|cell)\b"),
    "iban": (IBAN, None, _mod97, 0.9, r"\b(iban|account|bank|konto|bic)\b"),
    "ssn": (SSN, None, lambda m: ~F.substring(m, 1, 3).isin("000", "666"), 0.3, r"\b(ssn|social|security|insurance)\b"),
    "local_phone": (LOCAL_PHONE, None, lambda m: F.length(_digits(m)) == 10, 0.3, r"\b(phone|tel|call|mobile|fax|cell)\b"),
}
BASE = ("email", "ip", "card", "phone")

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _scored(kind: str, base: float, words: str, near):
    def span(s: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(base) + F.when(F.rlike(F.lower(near(s)), F.lit(words)), BOOST).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), score.alias("score"))

    return span


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def find(docs: DataFrame, text_col: str = "text", out_col: str = "pii", threshold: float = THRESHOLD, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """docs with ``out_col``: array of (kind, start, end, score) by kind as listed, then start; code points, end exclusive.

    Each kind's matches are leftmost and do not overlap; a match that its checksum or count rejects is dropped and not
    tried again. The score is the kind's, more by BOOST if one of its context words stands within BEFORE code points
    before or AFTER behind, 1 at most; spans below the threshold are dropped, kinds of BASE never. Null and empty texts
    give an empty array. A column named like ``out_col`` is replaced. One pass over each text, no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.drop(out_col).withColumns({f"__m_{k}": F.regexp_extract_all(text, F.lit(KINDS[k][0]), F.lit(0)) if KINDS[k][1] is None else F.when(KINDS[k][1](text), F.regexp_extract_all(text, F.lit(KINDS[k][0]), F.lit(0))) for k in kinds})
    empty = F.array().cast(SPAN)
    spans = []
    for k in kinds:
        pattern, _, confirm, base, words = KINDS[k]
        m = F.col(f"__m_{k}")
        # what lies between the matches gives their places
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("g"), F.length(x).alias("n"), confirm(x).alias("ok")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda acc, x: F.struct((acc.at + x.g + x.n).alias("at"), F.when(x.ok, F.concat(acc.out, F.array(F.struct((acc.at + x.g).alias("start"), (acc.at + x.g + x.n).alias("end"))))).otherwise(acc.out).alias("out"))
        near = lambda s: F.concat_ws(" ", F.substring(text, F.greatest(s.start - BEFORE, F.lit(0)) + 1, F.least(s.start, F.lit(BEFORE))), F.substring(text, s.end + 1, F.lit(AFTER)))
        scored = F.transform(F.aggregate(pairs, start, step, lambda acc: acc.out), _scored(k, base, words, near))
        spans.append(F.when(F.size(m) > 0, scored if k in BASE else F.filter(scored, lambda s: s.score >= threshold)).otherwise(empty))
    return found.withColumn(out_col, F.concat(*spans)).drop(*[f"__m_{k}" for k in kinds])


def redact(docs: DataFrame, text_col: str = "text", pii_col: str = "pii") -> DataFrame:
    """docs with each span of find() in ``text_col`` replaced by its kind in angle brackets; overlaps go with the first."""
    text = F.col(text_col)
    order = F.array_sort(F.transform(F.col(pii_col), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    step = lambda acc, s: F.when(s.start < acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit("<"), s.kind, F.lit(">")).alias("out")))
    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(pii_col) > 0, done).otherwise(text))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", *[F.size(_of("pii", k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(told(_of("pii", *BASE)), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda s: s.score)), F.lit(0.0)).alias("max_score"))
