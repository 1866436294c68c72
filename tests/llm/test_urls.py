from datetime import date

from millrace.llm.urls import judge


def test_as_of_suffixes_paths_and_edges(spark):
    d = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [("bad.com", None, "block", d(5)), ("bad.com", "", "allow", d(10)), ("ok.bad.com", "", "allow", d(1)), ("bad.com", "/x", "block", d(1)), ("bad.com", "", "block", d(20)), ("bad.com", "", "allow", d(20)), (None, "", "block", d(1)), ("n.com", "", "block", None)],
        "host string, path string, action string, since date",
    )
    cases = [
        ("http://bad.com/", d(4), False), ("http://bad.com/", d(5), True), ("https://u@WWW.Bad.com:80/a", d(9), True), ("http://bad.com.", d(10), False), ("http://bad.com?q", d(20), True),
        ("http://ok.bad.com/", d(6), False), ("http://notbad.com/", d(6), False), ("http://bad.com/xy", d(12), True), ("http://n.com", d(6), False), (None, d(6), False), ("http://bad.com/", None, False), ("", d(6), False), ("http://bad.com/", d(5), True),
    ]
    captures = spark.createDataFrame([(i, *c, "z") for i, c in enumerate(cases)], "id int, url string, fetched date, want boolean, host string")
    out = judge(captures, entries).collect()
    assert len(out) == len(cases) and all(r.blocked == r.want for r in out), [r for r in out if r.blocked != r.want]
    assert judge(captures, entries).columns == ["id", "url", "fetched", "want", "host", "rule", "blocked"]
    assert judge(captures, entries.limit(0)).where("blocked").count() == 0 and judge(captures.limit(0), entries).count() == 0
