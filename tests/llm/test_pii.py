import hashlib
import re

import pytest

from millrace.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.c_d@e.fg x@y.z.", "@@a@b a@b..c a.b@c-d.e-f.gh😀é q@w.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 0000255.1.1.1 99999999999999999999.1.1.1",
    "é😀 4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111111", "+1 (017) 555-7713 +12 +1--------9 +1 2 +123456789012345678", "card 4929348385146306é +49 30 1234567",
    "a" * 5000 + "@" + "b." * 3000 + "c " + "1" * 20000, "1 " * 20000, "9" * 12 + " " + "9" * 13 + "-" + "1" * 4, "4111 1111 1111 1111 4111 1111 1111 1111",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_brute_force(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind in BASE] for r in pii.find(rows(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), i


def test_driver_tables_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op1_pii(spark, "/root/testdata/sf0.001").collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for k, a, b in spans)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("pay to IBAN GB82 WEST 1234 5698 7654 32 now", ["iban"]),
        ("pay to IBAN GB82 WEST 1234 5698 7654 33 now", []),
        ("social security no 219-09-9999", ["ssn"]),
        ("part no 219-09-9999", []),
        ("call 555-123-4567", ["local_phone"]),
        ("room 555-123-4567", []),
    ],
)
def test_checksums_and_context(spark, text, kinds):
    assert [s.kind for s in pii.find(rows(spark, [text])).first().pii] == kinds


def test_redact_clashing_names_and_empty(spark):
    docs = rows(spark, ["mail a@b.cd or +1 (017) 555-7713!", None, ""]).selectExpr("*", "1 AS pii", "2 AS start", "'x' AS kind")
    out = pii.redact(pii.find(docs))
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["mail <email> or <phone>!", None, ""]
    assert set(out.columns) == {"doc_id", "text", "pii", "start", "kind"}
    assert pii.find(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    assert [len(r.pii) for r in pii.find(rows(spark, ["a@b.c"]).union(rows(spark, ["a@b.c"]))).collect()] == [1, 1]
