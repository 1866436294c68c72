"""Semantics, parsers, codecs, sessions and migration on tiny tables."""

import pytest
from pyspark.sql import functions as F

from millrace import filters, types
from millrace import functions as f
from millrace import operators as o
from millrace.errors import BadQuery, Conflict, NotFound, is_conflict, is_not_found, is_rolled_back
from millrace.executor import Executor, one_to_one, scan
from millrace.migrate import create_sql, diff, entities
from millrace.model import Catalog, Col, Model, column_name, fragment, index, parse_index, primary_key, render, table_name, unique_index
from millrace.operators import mutations as m
from millrace.plans import compile_block, safe_projected
from millrace.session import Endpoint, Session, register_catalog, session_for
from millrace.sorts import By
from millrace.sources import as_, from_, from_all, from_frame, value_omit_zero, values, values_omit
from millrace.streaming import stream

USER = Model(
    "t_user",
    (Col("f_id", "long", autoincrement=True), Col("f_name", default=""), Col("f_age", "long", default=0), Col("f_deleted_at", "long", default=0)),
    keys=(primary_key("f_id"), unique_index("i_name", "f_name", "f_deleted_at"), index("i_age", "f_age")),
    soft_delete=("f_deleted_at", 0),
)


@pytest.fixture
def users(spark):
    rows = [(1, "a", 10, 0), (2, "b", 20, 0), (3, "c", None, 0), (4, "d", 40, 9)]
    return Catalog.of(USER).bind("t_user", spark.createDataFrame(rows, "f_id long, f_name string, f_age long, f_deleted_at long"))


def ids(block, catalog):
    return sorted(r.f_id for r in compile_block(block, catalog).collect())


def test_soft_delete_and_null_predicates(users):
    assert ids(from_(USER), users) == [1, 2, 3] and ids(from_all(USER), users) == [1, 2, 3, 4]
    assert ids(from_(USER) | o.where(USER.f_age, f.neq(10)), users) == [2]
    assert ids(from_(USER) | o.where(USER.f_age, f.is_null()), users) == [3]
    assert ids(from_(USER) | o.where(USER.f_name, f.in_()), users) == [1, 2, 3]
    assert ids(from_(USER) | o.where(USER.f_name, f.like("\\")), users) == []


def test_not_in_with_a_null_lets_nothing_pass(users):
    sub = from_(USER) | o.where(USER.f_id, f.gt(0))
    assert ids(from_(USER) | o.where_not_in_select(USER.f_id, USER.f_age, sub), users) == []
    assert ids(from_(USER) | o.where_not_in_select(USER.f_id, USER.f_age, from_all(USER)), users) == [1, 2, 3]


def test_clause_order_and_nesting(users):
    assert ids(from_all(USER) | o.asc_sort(USER.f_id) | o.limit(1) | o.where(USER.f_id, f.gt(2)), users) == [3]
    assert ids(as_(from_all(USER) | o.asc_sort(USER.f_id) | o.limit(1), "x") | o.where(USER.f_id, f.gt(2)), users) == []
    executor = Executor(from_(USER), users).pipe(o.limit(1), o.compose(o.where(USER.f_id, f.gt(1)), o.desc_sort(USER.f_id)), o.for_update())
    assert [r.f_id for r in executor.list()] == [3] and executor.count() == 2 and executor.find_one().f_id == 3
    assert next(executor.items()).f_id == 3
    with pytest.raises(NotFound):
        Executor(from_(USER) | o.where(USER.f_id, f.gt(9)), users).must_one()
    assert scan(Executor(from_(USER) | o.where(USER.f_id, f.eq(3)), users).find_one(), USER)["f_age"] == 0


def test_upsert_rules(spark, users):
    target = users.frame(USER)
    rows = spark.createDataFrame([(1, "z", 1, 0), (7, "x", 1, 0), (7, "y", 1, 0), (None, "n", 1, 0)], target.schema)
    out = m.upsert(target, rows, ["f_id"])
    assert sorted(r.f_name for r in out.affected.collect()) == ["n", "x"] and out.after.count() == 6
    assert sorted(r.f_name for r in m.upsert(target, rows, ["f_id"], (), True).affected.collect()) == ["a", "n", "x"]
    with pytest.raises(Exception, match="given twice"):
        m.upsert(target, rows, ["f_id"], ["f_name"]).after.collect()
    once = m.upsert(target, rows.where("f_name in ('z', 'n')"), ["f_id"], ["f_name"])
    assert sorted((r.f_id or 0, r.f_name) for r in once.after.collect()) == [(0, "n"), (1, "z"), (2, "b"), (3, "c"), (4, "d")]


def test_session_versions_conflicts_and_transactions(spark, tmp_path):
    s = Session(spark, str(tmp_path), Catalog.of(USER), "main")
    register_catalog("main", s.catalog)
    assert session_for(USER) is s
    assert s.commit(values(spark, USER, [])) is None
    assert s.commit(values(spark, USER, [{"f_name": f"u{i}", "f_age": i, "f_deleted_at": 0} for i in range(20)])).count() == 20
    assert sorted(r.f_id for r in s.read(USER).collect()) == list(range(1, 21))
    s.commit(value_omit_zero(spark, USER, {"f_name": "solo", "f_age": 0, "f_deleted_at": 0}))
    assert Executor(from_(USER), s.catalog).count() == 21
    s.commit(from_(USER) | o.where(USER.f_name, f.eq("solo")) | m.do_delete(), now=99)
    assert Executor(from_(USER), s.catalog).count() == 20 and s.read(USER).count() == 21
    with pytest.raises(Conflict) as e:
        s.commit(values_omit(spark, USER, [{"f_name": "u1", "f_age": 1, "f_deleted_at": 0}]))
    assert is_conflict(e.value) and not is_not_found(e.value) and s.read(USER).count() == 21

    def broken(t):
        t.commit(from_(USER) | m.do_delete_hard())
        assert t.in_tx and Executor(from_(USER), t.catalog).count() == 0
        t.rollback()

    with pytest.raises(Exception) as e:
        s.tx(broken)
    assert is_rolled_back(e.value) and Executor(from_(USER), s.catalog).count() == 20
    s.tx(lambda t: t.commit(from_(USER) | m.do_delete(), now=5))
    assert Executor(from_(USER), s.catalog).count() == 0


@pytest.mark.parametrize("text", ["eq(1)", "and(gte(1),lte(10))", 'where("item.id",and(gte(1),lte(10)))', 'where("item.name",in("a","b","c"))', 'or(where("item.name",eq("x")),where("item.id",in(1,2,3,4)))', "in(-1,2.5,null,true)", 'contains("a),(b")', "intersection(in(1,2),in(2))"])
def test_filter_round_trip(text):
    assert str(filters.parse(text)) == text


def test_filter_errors_and_literals():
    assert filters.parse("1") == filters.eq(1) and filters.parse("-3") == filters.eq(-3)
    for bad in ("", "nope(1)", "eq(1", "eq(1))", "eq(x)", "1,2"):
        with pytest.raises(BadQuery):
            filters.parse(bad)
    with pytest.raises(BadQuery, match="unsupported ql field `missing`"):
        filters.compose({"id": USER.f_id}, 'or(where("missing",eq("alice")))')
    one = filters.compose({"id": USER.f_id}, id=filters.eq(1), other=filters.in_())
    assert str(one) == 'where("id",eq(1))' and str(filters.compose({"id": USER.f_id}, str(one))) == str(one)


def test_filters_on_a_block(users):
    assert ids(from_(USER) | filters.as_where(USER.f_name, 'or(prefix("a"),notin("a","b"))'), users) == [1, 3]
    assert ids(from_(USER) | filters.as_where(USER.f_name, "in()"), users) == [1, 2, 3]
    assert set(filters.indexed_filters(USER, "user")) == {"user~id", "user~name", "user~deletedAt", "user~age"}


def test_sort_text():
    assert By.parse("user~name!desc") == By("user~name", "desc") and str(By("a")) == "a!asc" and By.parse("") == By() and str(By()) == ""
    for bad in ("a", "a!up", "!asc"):
        with pytest.raises(BadQuery):
            By.parse(bad)
    assert [x for x, _ in By.options({"a": "A"})] == ["a!asc", "a!desc"]


def test_durations_and_codecs(spark):
    assert types.parse_duration("1wk") == 604800 * 10**9 and types.parse_duration("1.5h 2ms") == 5400 * 10**9 + 2 * 10**6
    assert types.is_duration("1  minute") and not types.is_duration("minute") and not types.is_duration("1 parsec")
    df = spark.createDataFrame([("1h30m", "", '{"a":1}', -5), ("x", None, None, 7)], "d string, e string, j string, s long")
    got = df.select(types.duration_ns(F.col("d")), types.null_if_empty(F.col("e")), types.from_json(F.col("j"), "a int")["a"], F.unix_timestamp(types.timestamp(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(5400 * 10**9, None, 1, 0), (None, None, None, 7)]
    day = spark.sql("SELECT TIMESTAMP'2023-01-31 10:00:00' AS t").select(F.date_format(types.add_date(F.col("t"), 0, 1, 0), "yyyy-MM-dd HH")).first()[0]
    assert day == "2023-03-03 10"
    assert types.local(0) == "1970-01-01T08:00:00+08:00"


def test_models_names_and_fragments():
    assert table_name("OrgUser") == "t_org_user" and column_name("Name") == "f_name" and column_name("Name", "F_X,size=2") == "f_x"
    assert parse_index("@def unique_index i_name Name Age,DESC").columns == ("Name", "Age") and parse_index("primary ID").kind == "primary"
    assert USER["Age"].name == "f_age" and USER.with_name("u").f_id.model.name == "u"
    with pytest.raises(KeyError):
        USER["nope"]
    assert render("a = ? AND b = '?' AND c IN (?) AND d = @x", (1, ["q'", 2]), {"x": None}) == "a = 1 AND b = '?' AND c IN ('q\\'', 2) AND d = NULL"
    with pytest.raises(ValueError):
        render("a", (1,))
    assert safe_projected("t_user", "f_id") == "t_user__f_id" and len(safe_projected("t_" + "very_long_" * 8, "f_id")) < 40
    other = Catalog.of(Model.of("t_org", "f_org_id long", keys=(primary_key("f_org_id"),)))
    assert Catalog.of(USER).require(other, Catalog.of(USER)).names() == ["t_user", "t_org"]


def test_diff_order_and_entities():
    v2 = Model("t_user", (Col("f_id", "long"), Col("f_name", deprecated="f_real_name"), Col("f_real_name"), Col("f_age", "int", default=0), Col("f_deleted_at", "long", deprecated=True), Col("f_new", null=True)), keys=(primary_key("f_id"), unique_index("i_name", "f_real_name"), index("i_age", "f_age")))
    assert [(a.kind, a.name) for a in diff(USER, v2)] == [("drop index", "i_age"), ("drop index", "i_name"), ("drop column", "f_deleted_at"), ("rename column", "f_name"), ("modify column", "f_age"), ("add column", "f_new"), ("add index", "i_age"), ("add index", "i_name")]
    assert diff(USER, USER) == [] and diff(None, USER)[0].kind == "create table"
    assert create_sql(USER).startswith("CREATE TABLE IF NOT EXISTS t_user (f_id BIGINT NOT NULL")
    org = Model.of("t_org_user", "f_rel long, f_id long", keys=(primary_key("f_rel"),))
    assert entities(Catalog.of(USER, org))["relations"] == [{"from": ["t_org_user", "f_id"], "to": ["t_user", "f_id"]}]


def test_endpoints():
    e = Endpoint.parse("postgres://u:p%40@h:5432/db?a=1")
    assert (e.user, e.password, e.host, e.port, e.path) == ("u", "p@", "h", 5432, "db") and e.masked() == "postgres://u:------@h:5432/db?a=1"
    assert e.patched(name="x", extra="b=2").extra == {"a": "1", "b": "2"}


def test_sets_and_streams(spark, users, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k int, v int")
    assert sorted(map(tuple, one_to_one(df, ["k"], "v").collect())) == [(1, 2), (2, 5)]
    users.frame(USER).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(users.frame(USER).schema).parquet(str(tmp_path / "in"))
    out = stream(USER, source, o.where(USER.f_age, f.gte(20)), o.select(USER.f_id))
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.f_id for r in spark.table("seen").collect()) == [2, 4]


def test_pushdown_reaches_the_scan(spark):
    from millrace.queries import LINEITEM, catalog

    cat = catalog(spark, "/root/testdata/sf0.001")
    df = compile_block(from_(LINEITEM) | o.where(LINEITEM.l_quantity, f.gt(40.0)) | o.select(LINEITEM.l_orderkey), cat)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_extendedprice" not in plan


def test_raw_set_and_group_helpers(users):
    block = o.aggregate(from_all(USER), f.count(f.distinct(USER.f_deleted_at)).as_("n"), f.max_(fragment("f_age")).as_("top"))
    assert tuple(compile_block(block, users).first()) == (2, 40)


def test_database_migrates_its_tables(spark, tmp_path):
    from millrace.session import Database

    old = Model.of("t_item", "f_id long, f_name string")
    new = Model("t_item", (Col("f_id", "long"), Col("f_name", deprecated="f_title"), Col("f_title"), Col("f_rank", "int", default=3)))
    db = Database("items", f"file://{tmp_path}")
    db.apply_catalog(Catalog.of(old)).init(spark).commit(values(spark, old, [{"f_id": 1, "f_name": "x"}]))
    assert db.run() == {}
    moved = Database("items", f"file://{tmp_path}", Catalog.of(new), enable_migrate=True)
    session = moved.init(spark)
    assert [a.kind for a in moved.run(Catalog.of(old))["t_item"]] == ["rename column", "add column"]
    assert session.read(new).first().asDict() == {"f_id": 1, "f_title": "x", "f_rank": 3}


def test_two_writers_of_a_table_conflict_and_of_two_do_not(spark, tmp_path):
    other = Model.of("t_other", "f_id long")
    a, b = (Session(spark, str(tmp_path), Catalog.of(USER, other), n) for n in ("a", "b"))
    row = [{"f_name": "x", "f_age": 1, "f_deleted_at": 0}]
    a.commit(values(spark, USER, row))

    def both(t):
        t.commit(from_(USER) | m.do_delete_hard())
        b.commit(values(spark, USER, [{"f_name": "y", "f_age": 2, "f_deleted_at": 0}]))

    with pytest.raises(Conflict):
        a.tx(both)
    assert sorted(r.f_name for r in a.read(USER).collect()) == ["x", "y"]

    def apart(t):
        t.commit(values(spark, other, [{"f_id": 7}]))
        b.commit(from_(USER) | o.where(USER.f_name, f.eq("y")) | m.do_delete_hard())

    a.tx(apart)
    assert [r.f_name for r in b.read(USER).collect()] == ["x"] and b.read(other).count() == 1


def test_a_commit_that_broke_off_does_not_count(spark, tmp_path):
    s = Session(spark, str(tmp_path), Catalog.of(USER), "c")
    s.commit(values(spark, USER, [{"f_name": "x", "f_age": 1, "f_deleted_at": 0}]))
    (tmp_path / "_commits" / f"{2:012d}").write_text("{")
    assert s.read(USER).count() == 1
    s.commit(values(spark, USER, [{"f_name": "y", "f_age": 1, "f_deleted_at": 0}]))
    assert s.read(USER).count() == 2


def test_read_split_and_scoped_sessions(spark, tmp_path):
    from millrace.session import ReadOnlySplit, from_context, injected

    writer, reader = Session(spark, str(tmp_path / "w"), Catalog.of(USER), "split"), Session(spark, str(tmp_path / "r"), Catalog.of(USER), "replica")
    both = ReadOnlySplit(writer, reader)
    both.commit(values(spark, USER, [{"f_name": "x", "f_age": 1, "f_deleted_at": 0}]))
    assert both.read(USER).count() == 0 and writer.read(USER).count() == 1
    seen = []
    both.tx(lambda t: seen.append(both.read(USER).count()))
    assert seen == [1] and session_for("split") is both and from_context("split") is None
    with injected(writer):
        assert session_for("split") is writer
    assert session_for("split") is both


def test_stamps_and_stable_numbers(spark):
    model = Model("t_s", (Col("f_id", "long", autoincrement=True), Col("f_v", "string"), Col("f_c", "long"), Col("f_u", "long")), created="f_c", updated="f_u")
    target = spark.createDataFrame([(4, "a", 1, 1)], model.schema())
    rows = spark.createDataFrame([(f"v{i}", 5 if i == 3 else 0) for i in range(50)], "f_v string, f_c long")
    first, again = (m.insert(target, rows.repartition(n), model, now=9).affected.orderBy("f_v").collect() for n in (1, 7))
    assert first == again and sorted(r.f_id for r in first) == list(range(5, 55))
    assert {(r.f_c, r.f_u) for r in first} == {(9, 9), (5, 9)}


def test_introspection_keeps_keys_and_defaults(spark):
    from millrace.migrate import create_sql, diff, drop_sql, index_sql, introspect, introspect_all
    from millrace.model import unique_index

    model = Model("t_intro", (Col("f_id", "long"), Col("f_n", "string", default="it's")), keys=(primary_key("f_id"), unique_index("i_n", "f_n")))
    spark.sql(create_sql(model))
    try:
        assert diff(introspect(spark, "t_intro"), model) == []
        spark.sql(index_sql(model, drop="i_n"))
        assert [a.kind for a in diff(introspect_all(spark).models["t_intro"], model)] == ["add index"]
    finally:
        spark.sql(drop_sql(model))


def test_fragments():
    from millrace import fragments as g

    assert g.collect(g.pair("a = ? AND b IN (?)", 1, g.values([1, "x"]))) == "a = 1 AND b IN (1, 'x')"
    assert g.collect(g.join_values(" AND ", g.const("a"), None, g.empty(), g.inline_block(g.const("b")))) == "a AND (b)"
    assert g.collect(g.block(g.const("a\nb"))) == "(\n\ta\n\tb\n)" and g.is_nil(g.block(None)) and g.is_nil(g.block_without_brackets([]))
    assert g.collect(g.block_without_brackets([g.const("a"), g.const("b")])) == "\n\ta,\nb\n"
    assert list(g.map_([1, 2], lambda i: g.const("x") if i > 1 else None)) == [g.const("x")]
    assert g.collect(g.pair("p = ?", g.Custom("unhex(?)", "41"))) == "p = unhex('41')"
    assert g.collect(None) == "" and g.collect(g.join(", ", [])) == ""


def test_views_are_not_left_behind(spark):
    from millrace.operators.cte import with_recursive

    spark.range(3).createOrReplaceTempView("mine")
    out = with_recursive(spark, "r", ["id", "d"], "SELECT id, 0 FROM mine WHERE id = 9 UNION ALL SELECT m.id, r.d + 1 FROM mine m JOIN r ON m.id = r.id + 1", "SELECT * FROM r", {"mine": spark.range(9, 12)})
    assert sorted(map(tuple, out.collect())) == [(9, 0), (10, 1), (11, 2)] and spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")
    quoted = Model("odd", (Col("a b", "long"),))
    sub = from_frame(quoted, spark.createDataFrame([(2,)], "`a b` long")) | o.where(quoted["a b"], f.gt(0))
    df = compile_block(from_frame(quoted, spark.createDataFrame([(1,), (2,)], "`a b` long")) | o.where_in_select(quoted["a b"], quoted["a b"], sub), Catalog())
    assert [r[0] for r in df.collect()] == [2]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__millrace")]
