"""Queries for the parts of the library that are not one block: rows to insert, verbs, sessions, codecs, metadata, DDL.

Facts that Python computes (names, texts, verdicts) are rows, compared with values that are written out in the SQL.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import errors, filters, migrate, sorts, types
from millrace import fragments as g
from millrace import functions as f
from millrace import operators as o
from millrace.executor import Executor, one_to_one, scan
from millrace.model import Catalog, Col, Model, column_name, fields_omit_zero, has_soft_delete, index, match_column, parse_index, primary_key, table_name, unique_index
from millrace.operators import mutations as m
from millrace.operators.cte import recursive
from millrace.plans import compile_block, safe_projected
from millrace.queries import CONVERSATIONS, LABELS, NATION, ORDERS, PART, REGION, SUPPLIER, _changed, block, query
from millrace.session import Database, Endpoint, ReadOnlySplit, Session, from_context, injected, register_catalog, session_for
from millrace.sources import from_, from_frame, value, value_omit, value_omit_zero, values, values_omit

R, N, O_, S, P = REGION, NATION, ORDERS, SUPPLIER, PART
ROW = {"r_regionkey": 9, "r_name": "NEW"}


def inserted(name: str, sql: str, make: Callable) -> None:
    """Regions after an insert."""
    query(name, f"SELECT * FROM region UNION ALL {sql}")(lambda spark, sf_dir, cat: m.apply(cat.frame(R), make(spark), cat).after)


inserted("value", "SELECT 9, 'NEW'", lambda spark: value(spark, R, ROW))
inserted("value_omit", "SELECT 9, ''", lambda spark: value_omit(spark, R, ROW, R.r_name))
inserted("value_omit_zero", "SELECT 0, 'NEW'", lambda spark: value_omit_zero(spark, R, {**ROW, "r_regionkey": 0}))
inserted("value_omit_zero_keep", "SELECT 9, ''", lambda spark: value_omit_zero(spark, R, {**ROW, "r_name": ""}, R.r_name))
inserted("value_seq", "SELECT * FROM (VALUES (10, 'r10'), (11, 'r11'))", lambda spark: values(spark, R, ({"r_regionkey": i, "r_name": f"r{i}"} for i in (10, 11))))
inserted("value_seq_omit", "SELECT * FROM (VALUES (10, ''), (11, ''))", lambda spark: values_omit(spark, R, ({"r_regionkey": i} for i in (10, 11)), R.r_name))


@query("insert_stamps", "SELECT * FROM (VALUES (1, 'old', 5, 5), (2, 'a', 77, 77), (3, 'b', 6, 77)) AS t(f_id, f_v, f_created, f_updated)")
def _(spark, sf_dir, cat):
    model = Model("t", (Col("f_id", "int", autoincrement=True), Col("f_v"), Col("f_created", "int"), Col("f_updated", "int")), created="f_created", updated="f_updated")
    target = spark.createDataFrame([(1, "old", 5, 5)], model.schema())
    return m.insert(target, spark.createDataFrame([("a", 0), ("b", 6)], "f_v string, f_created int").repartition(1), model, now=77).after.withColumn("f_id", F.when(F.col("f_v") == "old", 1).when(F.col("f_v") == "a", 2).otherwise(3))


_X = "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN {} ELSE n_regionkey END AS n_regionkey FROM nation"
_NEW_NATION = {"n_nationkey": 1, "n_name": "x", "n_regionkey": 8}
_changed("update_set_columns", N, _X.format("n_regionkey"), o.where(N.n_regionkey, f.eq(1)), m.do_update_set(N, _NEW_NATION, N.n_name))
_changed("update_set_omit", N, _X.format("8"), o.where(N.n_regionkey, f.eq(1)), m.do_update_set_omit(N, _NEW_NATION, N.n_nationkey))
_changed("update_by", N, "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS n_regionkey FROM nation", o.where(N.n_regionkey, f.eq(1)), m.do_update(N.n_regionkey, f.incr(10)))

# operators of one's own, pages, locks, comments, what has no operator
_top = lambda: from_(O_) | o.select(O_.o_orderkey) | o.desc_sort(O_.o_orderkey)
block("offset", lambda: _top() | o.limit(7) | o.offset(3), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7 OFFSET 3")
block("offset_before_limit", lambda: _top() | o.offset(3) | o.limit(7), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7 OFFSET 3")
block("operator_of_ones_own", lambda: _top() | o.operator(o.LIMIT, lambda b: b.with_(limit=4)), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 4")
block("addition", lambda: _top() | o.limit(9) | o.addition(lambda df: df.where("o_orderkey % 2 = 0")), "SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9) WHERE o_orderkey % 2 = 0")
block("comment", lambda: _top() | o.comment("the last orders") | o.limit(2), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 2")
block("columns_of", lambda: from_(N) | o.join_on(N.n_regionkey, R.r_regionkey) | o.select(*o.columns_of(N, R)), "SELECT n_nationkey AS nation__n_nationkey, n_name AS nation__n_name, n_regionkey AS nation__n_regionkey, r_regionkey AS region__r_regionkey, r_name AS region__r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
block("columns", lambda: from_(N) | o.select(*o.columns(N.n_name, N.n_regionkey)), "SELECT n_name, n_regionkey FROM nation")


@query("locks", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def _(spark, sf_dir, cat):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # each says that it does nothing
        locks = [o.for_update(skip_locked=True), o.for_no_key_update(no_wait=True), o.for_share(), o.for_key_share()]
    return Executor(from_(O_), cat).pipe(*locks, o.limit(3), o.desc_sort(O_.o_orderkey), o.select(O_.o_orderkey)).frame()


# fragments
block("fragment_join", lambda: from_(O_) | o.select(O_.o_orderkey) | o.where_cond(f.raw(g.join_values(" AND ", g.pair("o_orderstatus IN (?)", g.values(["F", "P"])), None, g.inline_block(g.pair("o_totalprice > @low OR o_orderkey < ?", 9, low=200000))))), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND (o_totalprice > 200000 OR o_orderkey < 9)")
block("fragment_func", lambda: from_(N) | o.select(N.n_nationkey, g.with_context(g.Func(lambda on: g.const("upper(n_name)") if on.get("loud") else None), loud=True).as_("a"), g.Func(lambda on: g.const("n_name") if on.get("loud") else None).as_("b")), "SELECT n_nationkey, upper(n_name) AS a, NULL AS b FROM nation")
block("fragment_custom_arg", lambda: from_(N) | o.select(N.n_nationkey, g.pair("concat(n_name, ?, ?)", g.Custom("upper(?)", "x"), g.const("'y'")).as_("t")), "SELECT n_nationkey, n_name || 'Xy' AS t FROM nation")


@query("fragment_texts", "SELECT * FROM (VALUES ('block', '(' || chr(10) || chr(9) || 'a' || chr(10) || ')'), ('collect', 'a = 1 AND b = ''x'''), ('empty', ''), ('inline', '(a)'), ('lines', chr(10) || chr(9) || 'a,' || chr(10) || 'b' || chr(10)), ('map', 'b1, b2')) AS t(name, text)")
def _(spark, sf_dir, cat):
    a = g.const("a")
    texts = {"block": g.block(a), "collect": g.pair("a = ? AND b = @b", 1, b="x"), "empty": g.join(", ", g.non_nil([None, g.empty()])), "inline": g.inline_block(a), "lines": g.block_without_brackets([a, g.const("b")]), "map": g.join(", ", g.map_([0, 1, 2], lambda i: g.const(f"b{i}") if i else None))}
    return spark.createDataFrame([(n, g.collect(t)) for n, t in texts.items()], "name string, text string")


# recursive expressions over blocks
@query("cte_recursive_blocks", "WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS k, conv_id * 1000 + turn - 1 AS up, 0 AS level FROM conversations WHERE turn = 0 UNION ALL SELECT t.conv_id * 1000 + t.turn, t.conv_id * 1000 + t.turn - 1, r.level + 1 FROM conversations t JOIN r ON t.conv_id * 1000 + t.turn - 1 = r.k) SELECT level, count(*) AS n FROM r GROUP BY level")
def _(spark, sf_dir, cat):
    made = Model.of("walk", "k long, up long, level int")
    turns = CONVERSATIONS
    both = (turns.turn.fragment("conv_id * 1000 + #").as_("k"), turns.turn.fragment("conv_id * 1000 + # - 1").as_("up"))
    final = lambda: o.aggregate_group_by(from_(made), [made.level], made.level, f.count().as_("n"))
    return recursive(made, from_(turns) | o.where(turns.turn, f.eq(0)) | o.select(*both), made.up, made.k, from_(turns) | o.select(*both), final, cat, spark, 1000)


# verbs
def _cheap() -> tuple:
    return o.where(O_.o_totalprice, f.lt(20000.0)), o.asc_sort(O_.o_orderkey), o.select(O_.o_orderkey)


@query("executor_find_one", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice < 20000")
def _(spark, sf_dir, cat):
    return spark.createDataFrame([Executor(from_(O_), cat).pipe(*_cheap()).find_one()], "o_orderkey long")


@query("executor_rows", "SELECT v.verb, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_totalprice < 20000 ORDER BY o_orderkey LIMIT 20) CROSS JOIN (VALUES ('items'), ('list'), ('list_to')) AS v(verb)")
def _(spark, sf_dir, cat):
    e, got = Executor(from_(O_), cat).pipe(*_cheap(), o.limit(20)), []
    e.list_to(got.append)
    rows = {"items": list(e.items()), "list": e.list(), "list_to": got}
    return spark.createDataFrame([(v, r.o_orderkey) for v, found in rows.items() for r in found], "verb string, o_orderkey long")


@query("scan_nulls", "SELECT * FROM (VALUES (0, '', 0.0::DOUBLE)) AS t(a, b, c)")
def _(spark, sf_dir, cat):
    model = Model.of("t", "a int, b string, c double")
    return spark.createDataFrame([tuple(scan(spark.createDataFrame([(None, None, None)], "a int, b string, c double").first(), model).values())], "a int, b string, c double")


@query("one_to_one", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, sf_dir, cat):
    return one_to_one(cat.frame(O_).select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


# sessions; tables lie under the warehouse folder, which a cluster shares
def _folder(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-{uuid.uuid4().hex}"


def _session(spark: SparkSession, cat: Catalog, *models: Model) -> Session:
    s = Session(spark, _folder(spark), Catalog.of(*models), uuid.uuid4().hex)
    for model in models:
        s.write(model, cat.frame(model))
    return s


@query("session_commit", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'low' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NEW'")
def _(spark, sf_dir, cat):
    s = _session(spark, cat, R)
    s.commit(value(spark, R, ROW))
    Executor(from_(R), s.catalog).pipe(m.do_update(R.r_name, f.value("low")), o.where(R.r_regionkey, f.eq(1))).commit(s)
    return s.read(R)


@query("session_tx", "SELECT 'region' AS name, count(*) + 1 AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 1")
def _(spark, sf_dir, cat):
    s = _session(spark, cat, R, N)

    def change(t: Session) -> None:
        t.commit(value(spark, R, ROW))
        t.tx(lambda inner: inner.commit(from_(N) | o.where(N.n_regionkey, f.eq(1)) | m.do_delete_hard()))

    def broken(t: Session) -> None:
        t.commit(from_(R) | m.do_delete_hard())
        t.rollback()

    s.tx(change)
    try:
        s.tx(broken)
    except Exception as e:
        assert errors.is_rolled_back(e)
    return spark.createDataFrame([(t.name, Executor(from_(t), s.catalog).count()) for t in (R, N)], "name string, n long")


@query("session_lookup", "SELECT * FROM (VALUES ('by model', true), ('by name', true), ('in context', true), ('not in context', true), ('split reads', true), ('unknown', true)) AS t(what, holds)")
def _(spark, sf_dir, cat):
    a, b = _session(spark, cat, R), _session(spark, cat, N)
    register_catalog(a.name, Catalog.of(Model("only_here", (Col("a"),))))
    split = ReadOnlySplit(b, a)
    with injected(a):
        inside = from_context(a.name) is a
    try:
        session_for("nowhere")
    except Exception as e:
        unknown = errors.is_not_found(e)
    facts = {"by model": session_for(Model("only_here", (Col("a"),))) is a, "by name": session_for(a.name) is a, "in context": inside, "not in context": from_context(a.name) is None, "split reads": split.read(R).count() > 0, "unknown": unknown}
    return spark.createDataFrame(list(facts.items()), "what string, holds boolean")


@query("database_migrates", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name AS r_title, 3 AS r_rank FROM region")
def _(spark, sf_dir, cat):
    where = f"file://{_folder(spark).removeprefix('file:')}"
    first = Database("db", where, Catalog.of(R))
    first.init(spark).write(R, cat.frame(R))
    new = Model("region", (Col("r_regionkey", "long"), Col("r_name", deprecated="r_title"), Col("r_title"), Col("r_rank", "int", default=3)), keys=(unique_index("i_title", "r_title"),))
    second = Database("db", where, Catalog.of(new), enable_migrate=True)
    session = second.init(spark)
    second.run()
    assert migrate.diff(session.stored().models["region"], new) == []
    return session.read(new)


@query("endpoints", "SELECT * FROM (VALUES ('masked', 'postgres://u:------@h:5432/db?sslmode=off'), ('parsed', 'postgres://u:p w@h:5432/db?sslmode=off'), ('patched', 'postgres://u2:p w@h:5432/other?sslmode=on')) AS t(what, text)")
def _(spark, sf_dir, cat):
    e = Endpoint.parse("postgres://u:p%20w@h:5432/db?sslmode=off")
    return spark.createDataFrame([("parsed", str(e)), ("masked", e.masked()), ("patched", str(e.patched(name="other", user="u2", extra="sslmode=on")))], "what string, text string")


@query("error_kinds", "SELECT * FROM (VALUES ('conflict', false, true, false), ('not found', true, false, false), ('rolled back', false, false, true)) AS t(what, not_found, conflict, rolled_back)")
def _(spark, sf_dir, cat):
    found = {"not found": errors.NotFound("x"), "conflict": errors.Conflict("x"), "rolled back": errors.RolledBack("x")}
    return spark.createDataFrame([(n, errors.is_not_found(e), errors.is_conflict(e), errors.is_rolled_back(e)) for n, e in found.items()], "what string, not_found boolean, conflict boolean, rolled_back boolean")


# the filter and sort languages
block("filter_dsl_contains", lambda: from_(P) | o.select(P.p_partkey) | filters.as_where(P.p_name, 'contains("ll r")'), "SELECT p_partkey FROM part WHERE p_name LIKE '%ll r%'")
block("filter_dsl_notin", lambda: from_(P) | o.select(P.p_partkey) | filters.as_where(P.p_size, "notin(1,2,3)"), "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)")
block("filter_in_seq", lambda: from_(P) | o.select(P.p_partkey) | filters.as_where(P.p_size, filters.in_seq(range(4, 7))), "SELECT p_partkey FROM part WHERE p_size IN (4, 5, 6)")
block("filter_not_in_seq", lambda: from_(P) | o.select(P.p_partkey) | filters.as_where(P.p_size, filters.not_in_seq(range(4, 40))), "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 4 AND 39")
block("filter_lit", lambda: from_(P) | o.select(P.p_partkey) | filters.as_where(P.p_size, filters.lit(7)), "SELECT p_partkey FROM part WHERE p_size = 7")


@query("filter_parts", """SELECT * FROM (VALUES ('composed', 'or(where("a",eq(1)),where("b",gt(2)))'), ('first', 'gt(2)'), ('map_filter', 'eq,gt'), ('map_where', 'a,b'), ('text', 'and(eq("x"),notin(1,2.5))'), ('values', '1,2')) AS t(what, text)""")
def _(spark, sf_dir, cat):
    rule = filters.parse('and(eq("x"), notin(1, 2.5))')
    both = filters.compose({"a": P.p_size, "b": P.p_size}, 'or(where("a",eq(1)),where("b",gt(2)))')
    parts = [filters.eq(1), filters.gt(2)]
    facts = {"text": str(rule), "composed": str(both), "first": str(filters.first(parts, lambda r: r.op == "gt")), "map_filter": ",".join(filters.map_filter(["x", *parts], lambda r: r.op)), "map_where": ",".join(filters.map_where(both.rules, lambda r: r.args[0])), "values": ",".join(str(v) for r in parts for v in filters.and_(r).filters[0].values)}
    return spark.createDataFrame(list(facts.items()), "what string, text string")


@query("sort_text", "SELECT * FROM (VALUES ('created~at!asc'), ('created~at!desc')) AS t(text)")
def _(spark, sf_dir, cat):
    return spark.createDataFrame([(str(sorts.By.parse(t)),) for t in ("created~at!asc", "created~at!desc")], "text string")


# codecs
@query("timestamp_parts", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS text, hour(ts + INTERVAL 8 HOUR)::INT AS local_hour, floor(epoch(ts))::BIGINT + 90 AS later, (floor(epoch(ts))::BIGINT - 1704067200) * 1000000000 AS since, false AS zero FROM events")
def _(spark, sf_dir, cat):
    ts, s = F.col("ts"), types.seconds(F.col("ts"))
    made = {"y": types.year(ts), "m": types.month(ts), "d": types.day(ts), "text": types.format_timestamp(ts), "local_hour": F.hour(types.in_zone(ts, "Asia/Shanghai")), "later": types.add(s, 90 * 10**9), "since": types.sub(s, F.lit(1704067200)), "zero": types.is_zero(s)}
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[c.alias(n) for n, c in made.items()])


@query("timestamp_parse", "SELECT * FROM (VALUES ('01.02.2024', 1706716800), ('2024-02-01', 1706745600), ('2024-02-01 10:00:00', 1706781600), ('2024-02-01T10:00:00+02:00', 1706774400), ('x', 0)) AS t(text, s)")
def _(spark, sf_dir, cat):
    types.add_supported_layout("dd.MM.yyyy", "Asia/Shanghai")
    texts = spark.createDataFrame([(t,) for t in ("2024-02-01T10:00:00+02:00", "2024-02-01 10:00:00", "2024-02-01", "01.02.2024", "x")], "text string")
    return texts.select("text", types.seconds(types.parse_any(F.col("text"))).cast("int").alias("s"))


@query("timestamp_layouts", "SELECT event_id, strftime(ts, '%d/%m/%Y') AS text, floor(epoch(date_trunc('day', ts)))::BIGINT AS day FROM events")
def _(spark, sf_dir, cat):
    before = types.output_layout[0]
    types.set_output_layout("dd/MM/yyyy")
    made = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", types.format_any(F.col("ts")).alias("text"))
    types.set_output_layout(*before)
    return made.withColumn("day", types.seconds(types.parse_timestamp(F.col("text"), ("dd/MM/yyyy",))))


@query("duration_check", "SELECT * FROM (VALUES ('1h30m', true), ('1 week', true), ('h1', false), ('', false)) AS t(text, holds)")
def _(spark, sf_dir, cat):
    return spark.createDataFrame([(t, types.is_duration(t)) for t in ("1h30m", "1 week", "h1", "")], "text string, holds boolean")


@query("json_codecs", "SELECT n_nationkey, '{\"k\":' || n_nationkey || '}' AS object, CASE WHEN n_nationkey = 0 THEN '' ELSE '[' || n_nationkey || ']' END AS list, n_nationkey AS back, n_nationkey::VARCHAR AS value FROM nation")
def _(spark, sf_dir, cat):
    key = F.col("n_nationkey")
    made = cat.frame(N).select("n_nationkey", types.to_json(F.struct(key.alias("k"))).alias("object"), types.array_to_json(F.when(key == 0, F.array().cast("array<int>")).otherwise(F.array(key))).alias("list"))
    back = F.coalesce(types.from_json(F.col("list"), "array<int>")[0], F.lit(0))
    return made.withColumns({"back": back, "value": types.json_value(F.col("object"), "$.k")})


@query("now", "SELECT true AS holds")
def _(spark, sf_dir, cat):
    return spark.createDataFrame([(types.now() > 1_700_000_000,)], "holds boolean")


# models and catalogs
@query("model_facts", """SELECT * FROM (VALUES ('column from field', 'f_user_name'), ('column from tag', 'f_id'), ('computed', 'n_name'), ('fields', 'n_name,n_nationkey'), ('index', 'index:i_a:BTREE:Name,Age:/desc'), ('key', 'primary:n_nationkey'), ('long name', 't_aaaaaaaa__' || repeat('c', 60)), ('match', 'true,true,false'), ('not zero', 'a,c'), ('other name', 'n2:nation'), ('recast', 'long'), ('soft delete', 'true,false'), ('table', 't_org_user_group'), ('unique', 'unique:i_u:Name')) AS t(what, text)""")
def _(spark, sf_dir, cat):
    key, i, u = primary_key("n_nationkey"), parse_index("@def index i_a,BTREE Name Age,DESC"), parse_index("unique_index i_u Name")
    yes = lambda *x: ",".join(str(v).lower() for v in x)
    facts = {
        "column from field": column_name("User_Name"), "column from tag": column_name("ID", "f_id,autoincrement"), "computed": N.n_name.computed_by(f.func("upper", N.n_name)).name, "fields": ",".join(c.name for c in N.cols("n_name", "n_nationkey")),
        "index": f"{i.kind}:{i.name}:{i.method}:{','.join(i.columns)}:{'/'.join(','.join(x) for x in i.options)}", "key": f"{key.kind}:{','.join(key.columns)}", "long name": "t_aaaaaaaa__" + safe_projected("t_long", "c" * 60).split("__")[1],
        "match": yes(match_column(N.n_name, "n_name"), match_column(N.n_name, N.n_name.field), match_column(N.n_name, "name")), "not zero": ",".join(fields_omit_zero({"a": 1, "b": 0, "c": "", "d": None}, ["c"])), "other name": f"{N.with_name('n2').name}:{N.with_name('n2').table}",
        "recast": N.n_nationkey.cast_type("long").type, "soft delete": yes(has_soft_delete(LABELS), has_soft_delete(N)), "table": table_name("UserGroup", "org"), "unique": f"{u.kind}:{u.name}:{','.join(u.columns)}",
    }
    return spark.createDataFrame(list(facts.items()), "what string, text string")


@query("catalog_tables", "SELECT * FROM (VALUES ('nation', 0), ('region', 1), ('orders', 2)) AS t(name, place)")
def _(spark, sf_dir, cat):
    c = Catalog.of(N, P, R).require(Catalog.of(O_, R))
    c.remove("part")
    return spark.createDataFrame([(n, i) for i, n in enumerate(c.names())], "name string, place int")


@query("entity_relations", "SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey')) AS t(a, b, c, d)")
def _(spark, sf_dir, cat):
    nation = Model("nation", N.columns, N.keys, relations=(("n_regionkey", "region", "r_regionkey"),))
    return spark.createDataFrame([(*r["from"], *r["to"]) for r in migrate.entities(Catalog.of(R, nation))["relations"]], "a string, b string, c string, d string")


@query("ddl", "SELECT * FROM (VALUES ('a', 'add index', 'i_b'), ('b', 'add column', 'f_c'), ('b', 'drop column', 'f_a'), ('b', 'drop index', 'i_a'), ('c', 'rows', '0')) AS t(step, kind, name)")
def _(spark, sf_dir, cat):
    name = f"t_{uuid.uuid4().hex}"
    one = Model(name, (Col("f_id", "long"), Col("f_a")), keys=(primary_key("f_id"), index("i_a", "f_a")))
    two = Model(name, (Col("f_id", "long"), Col("f_a", deprecated=True), Col("f_c", "int")), keys=(primary_key("f_id"),))
    try:
        migrate.create_tables(spark, Catalog.of(one))
        spark.sql(migrate.create_sql(one))  # exists already
        more = Model(name, one.columns, (*one.keys, unique_index("i_b", "f_id", "f_a")))
        rows = [("a", a.kind, a.name) for a in migrate.diff(migrate.introspect(spark, name), more)]
        rows += [("b", a.kind, a.name) for a in migrate.diff(migrate.introspect_all(spark).models[name], two)]
        spark.sql(f"INSERT INTO {name} VALUES (1, 'x')")
        spark.sql(migrate.truncate_sql(one))
        rows.append(("c", "rows", str(spark.table(name).count())))
        spark.sql(migrate.index_sql(one, drop="i_a"))
        assert migrate.introspect(spark, name).keys == (primary_key("f_id"),)
    finally:
        spark.sql(migrate.drop_sql(one))
    return spark.createDataFrame(rows, "step string, kind string, name string")


@query("from_source", "SELECT n_name FROM nation WHERE n_nationkey < 5")
def _(spark, sf_dir, cat) -> DataFrame:
    return Executor(from_frame(N, cat.frame(N).where("n_nationkey < 5")), cat).pipe(o.select(N.n_name)).frame()


@query("compiled_alone", "SELECT DISTINCT n_regionkey FROM nation")
def _(spark, sf_dir, cat) -> DataFrame:
    return compile_block(from_(N) | o.select(N.n_regionkey) | o.distinct(), cat)
