import hashlib
import random

import pytest

from millrace.llm.lines import dedup_lines, op7_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, edits):
    """Within so many edits? Common ends are set aside first."""
    if abs(len(a) - len(b)) > edits:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= edits or (edits > 1 and distance(a, b) <= edits)


def brute(rows, edits, min_chars):
    first = {}
    texts = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in texts:
        for no, line in enumerate(t.split("\n")):
            if line.encode().split():
                first.setdefault(line, (i, t, no))
    lines = list(first)
    rank = {line: n for n, line in enumerate(lines)}
    bad, links = set(), dict.fromkeys(lines, 0)
    by_length = {}
    for line in lines:
        if len(line) >= min_chars:
            by_length.setdefault(len(line), []).append(line)
    for n, own in by_length.items():
        for gap in range(edits + 1):
            for x in own:
                for y in by_length.get(n + gap, []):
                    if (gap or rank[x] < rank[y]) and near(x, y, edits):
                        links[x] += 1
                        links[y] += 1
                        bad.add(max(x, y, key=rank.__getitem__))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n") if t is not None else []
        real = [x for x in parts if x.encode().split()]
        stay = [x for no, x in enumerate(parts) if not x.encode().split() or (first[x] == (i, t, no) and x not in bad)]
        n = sum(links[x] for no, x in enumerate(parts) if x in first and first[x] == (i, t, no))
        out.append((i, len(real), len(real) - sum(bool(x.encode().split()) for x in stay), n, None if t is None else "\n".join(stay)))
    return sorted(out, key=str)


def got(df, edits, min_chars):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.n_links, r.kept_text) for r in dedup_lines(df, edits, min_chars).collect()), key=str)


@pytest.mark.parametrize(("edits", "min_chars"), [(1, 5), (1, 20), (2, 5), (0, 5)])
def test_against_brute_force(spark, edits, min_chars):
    rng = random.Random(edits)
    base = ["the quick brown fox jumps over", "ein größerer Satz mit Umlauten äöü", "x" * 40, "abc", "12345", "a" * 300]
    rows = [(None, "abc\n\nabd"), (1, None), (2, ""), (3, "\n \n"), (4, "😀" * 30 + "\n" + "😀" * 29)]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(2)] = rng.choice(["", "z", "é"])
            lines.append("".join(line))
        rows.append((10 + i, "\n".join(lines)))
    rows += [rows[-1], rows[0]]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), edits, min_chars) == brute(rows, edits, min_chars)


def test_many_lines_with_a_common_half(spark):
    rng = random.Random(9)
    rows = [(i, "the very same beginning of a long line " + "".join(rng.choice("ab") for _ in range(8)) + "".join(rng.choice("cd") for _ in range(32))) for i in range(150)]
    rows += [(200 + i, rows[i][1][:-1]) for i in range(20)] + [(300 + i, "".join(rng.choice("ab") for _ in range(30)) + " and the end that all of them have in common") for i in range(40)]
    rows += [(400 + i, rows[180 + i][1][1:]) for i in range(20)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 1, 20) == brute(rows, 1, 20)


def test_records_meet_only_within_the_edit(spark, monkeypatch):
    """Long lines that differ in a number: candidates grow with the lines, not with their square."""
    from pyspark.sql import functions as F

    from millrace.llm import lines

    seen = {}
    keep = lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: seen.setdefault(name, []).append(keep(df, name)) or seen[name][-1])
    monkeypatch.setattr(lines, "forget", lambda *tables: None)
    form = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(i, f"{form}{1000 + 7919 * i % 9000}{i * 104729 % 9973:04d}{form[::-1]}") for i in range(400)]
    rows += [(500, rows[3][1].replace("a", "A", 1)), (501, rows[5][1][:-1])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 1, 20) == brute(rows, 1, 20)
    assert seen["candidates"][0].agg(F.count("a1")).first()[0] < 3000


def test_driver_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = sorted((i, n, d, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, k, t in brute(rows, 1, 20))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.n_links, r.kept_sha256) for r in op7_lines(spark, "/root/testdata/sf0.01").collect()) == want


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 3, 4)], "doc_id long, text string, line string, n_lines int, id int")
    assert dedup_lines(df).first().asDict() == {"doc_id": 1, "text": "a b", "line": "x", "id": 4, "n_lines": 1, "n_dropped": 0, "n_links": 0, "kept_text": "a b"}
    assert dedup_lines(df.limit(0)).count() == 0
