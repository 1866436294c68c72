import random

from pyspark.sql import functions as F

from millrace.llm.common import components
from millrace.llm.near import drop_near, near_duplicates, op8_near


def shingle_set(text):
    w = bytes((text or "").encode()).lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in inverted.values() for a in ids for b in ids if a < b}:
        a, b = pair
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, percent).collect()}
    assert got == brute(rows, percent)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "É é"), (6, "é é")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(10, 120):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(200, 230):  # each links with its neighbours only
        chain[(i - 200) * 6] = "x%d" % i
        rows.append((i, " ".join(chain)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    for percent in (85, 80):
        check(spark, rows, percent)


def test_driver_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op8_near(spark, "/root/testdata/sf0.001").collect()} == brute(rows, 85)


def test_nulls_repeats_empty_and_clashes(spark):
    df = spark.createDataFrame([(None, "a b", 1, 1), (None, "a b", 1, 1), (7, "a b c d e f", 1, 1), (7, "a b c d e f", 1, 1), (9, "A b c d e f", 1, 1)], "doc_id long, text string, n int, rep int")
    out = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert out == [("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in drop_near(df).collect()) == ["7", "None", "None"]
    assert drop_near(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (5, None), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("node")).first()[0] == 0


def test_an_id_with_different_texts(spark):
    """Each row goes by its own text; of rows that agree, one stays."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(61)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1][:-1] + "z"), (3, texts[2]), (3, texts[2]), (4, texts[2].upper()), (5, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert out == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 1, False)]
    assert sorted((r.doc_id, r.text) for r in drop_near(df, 85).collect()) == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2])])


def test_a_template_does_not_list_its_pairs(spark):
    """Texts alike at 0.7 share bands by the thousand, but no prefix; two near copies among them are found."""
    from pyspark.sql import types as T

    from millrace.llm.near import cross_pairs, prefix_keys, star_pairs
    from millrace.llm.shingles import hashed

    rng = random.Random(4)
    template = [rng.choice("abcdefghij") + str(i) for i in range(170)]
    rows = [(i, " ".join(template[:85] + [f"{i}x{k}" for k in range(30)] + template[85:])) for i in range(150)]
    rows += [(5000, rows[70][1].replace("70x29", "other"))]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("token", T.LongType())])
    sets = [(i, hashed(t.encode()).view("int64").tolist()) for i, t in rows]
    tokens = spark.createDataFrame([(i, i, len(s), x) for i, s in sets for x in s], schema)
    for percent in (85, 80):
        keyed = prefix_keys(tokens, percent)
        assert [tuple(r) for r in star_pairs(keyed).collect()] == [(70, 5000)] == [tuple(r) for r in cross_pairs(keyed).collect()]
    check(spark, rows, 85)


def test_groups_of_a_crowded_place(spark):
    """A place of 400 classes is met in groups: pairs grow with the classes, and each is one that cross_pairs() lists."""
    from millrace.llm.near import GROUP, cross_pairs, group_pairs

    crowd = spark.range(400).selectExpr("1L AS at", "0 AS side", "id AS key", "id AS c")
    few = spark.createDataFrame([(2, -1, 500, 500), (2, 1, 501, 501), (2, 1, 502, 500)], "at long, side int, key long, c long")
    keyed = crowd.union(few)
    met, all_ = ({tuple(r) for r in f(keyed).collect()} for f in (group_pairs, cross_pairs))
    assert met <= all_ and len(all_) == 400 * 399 // 2 + 1
    assert (500, 501) in met and (500, 502) not in met
    assert 400 <= len(met) <= 2 * 400 * GROUP


def test_a_crowd_around_one_text_does_not_list_its_pairs(spark):
    """Texts alike at about 0.76, each linked with the one in their middle: by differences they meet that, not each other."""
    from pyspark.sql import types as T

    from millrace.llm.near import cross_pairs, crowded_places, delta_keys, prefix_keys
    from millrace.llm.shingles import hashed

    rng = random.Random(6)
    base = [rng.choice("abcdefghij") + str(i) for i in range(150)]
    rows = [(900, " ".join(base))]
    for i in range(300):
        t = list(base)
        for j in range(2):
            at = rng.randrange(5, len(t) - 5)
            t[at : at + 1] = [[f"x{i}.{j}"], [f"x{rng.randrange(9)}"], [], [t[at], f"x{i}.{j}"]][rng.choice([0, 0, 0, 1, 2, 3])]
        rows.append((i, " ".join(t)))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("token", T.LongType())])
    found = {i: hashed(t.encode()).view("int64").tolist() for i, t in rows}
    tokens = spark.createDataFrame([(i, i, len(s), x) for i, s in found.items() for x in s], schema).localCheckpoint()
    sets = tokens.groupBy("key", "n").agg(F.collect_list("token").alias("tokens"))
    known = {i: set(s) for i, s in found.items()}
    for percent, share in ((85, 4), (80, 1.5)):
        keyed = prefix_keys(tokens, percent).localCheckpoint()
        crowded = crowded_places(keyed).localCheckpoint()
        before = {tuple(r) for r in cross_pairs(keyed).collect()}
        meet = cross_pairs(keyed.join(crowded, "at", "left_anti")).union(cross_pairs(delta_keys(keyed, crowded, sets, percent)))
        after = {tuple(r) for r in meet.collect()}
        links = {(a, b) for a in known for b in known if a < b and 100 * len(known[a] & known[b]) >= percent * len(known[a] | known[b])}
        assert links <= before and links <= after
        assert share * len(after) <= len(before)
    check(spark, rows, 85)
