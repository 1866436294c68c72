"""The library's queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import filters, sorts, types
from millrace import functions as f
from millrace import operators as o
from millrace.executor import Executor, first_records, one_to_multi
from millrace.migrate import diff, migrated
from millrace.model import Catalog, Col, Model, fragment, index, primary_key, unique_index
from millrace.operators import mutations as m
from millrace.operators.cte import with_, with_recursive
from millrace.plans import Block, compile_block
from millrace.sources import as_, from_, from_all, from_frame, insert_from, values

REGION = Model.of("region", "r_regionkey int, r_name string", keys=(primary_key("r_regionkey"), unique_index("i_name", "r_name")))
NATION = Model.of("nation", "n_nationkey int, n_name string, n_regionkey int", keys=(primary_key("n_nationkey"),))
CUSTOMER = Model.of("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", keys=(primary_key("c_custkey"),))
SUPPLIER = Model.of("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", keys=(primary_key("s_suppkey"),))
PART = Model.of("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", keys=(primary_key("p_partkey"), index("i_brand", "p_brand")))
ORDERS = Model.of("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", keys=(primary_key("o_orderkey"),))
OPEN_ORDERS = Model.of("open_orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", table="orders", soft_delete=("o_orderstatus", "O"))
LINEITEM = Model.of("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
EVENTS = Model.of("events", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", keys=(primary_key("event_id"),))
DOCUMENTS = Model.of("documents", "doc_id long, text string, lang string, source string, n_chars long", keys=(primary_key("doc_id"),))
LABELS = Model.of("labels", "doc_id long, quality int, toxic int", keys=(primary_key("doc_id"),), soft_delete=("toxic", 0))
CONVERSATIONS = Model.of("conversations", "conv_id long, turn long, role string, text string")

R, N, C, S, P, O_, L, E, D, LB = REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, LABELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.parquet(spark, sf_dir, REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, LABELS, CONVERSATIONS)


def block(name: str, make: Callable[[], Block], sql: str) -> None:
    """A query that is one block."""
    QUERIES[name] = lambda spark, sf_dir: compile_block(make(), catalog(spark, sf_dir))
    SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str, Catalog], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, catalog(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def money(x: str | Col) -> object:
    """An exact sum of doubles with two decimals."""
    return f.sum_(fragment(f"CAST({x if isinstance(x, str) else x.name} AS DECIMAL(18,2))"))


def as_double(e: object, name: str) -> object:
    class Cast(type(e)):  # the same expression, cast
        def resolve(self, at):
            return super().resolve(at).cast("double")

    return Cast(e.function, e.args, e.order).as_(name)


def _pick(model: Model, *cols: Col) -> Block:
    return from_(model) | o.select(*cols)


# scans and projections
block("from_all", lambda: from_all(O_), "SELECT * FROM orders")
block("select_cols", lambda: _pick(O_, O_.o_orderkey, O_.o_totalprice), "SELECT o_orderkey, o_totalprice FROM orders")
block("project_expr", lambda: from_(O_) | o.project(O_.o_orderkey, O_.o_totalprice.fragment("# * ? + 1", 2).as_("twice"), fragment("concat(@a, 'x?')", a="p").as_("tag")), "SELECT o_orderkey, o_totalprice * 2 + 1 AS twice, 'px?' AS tag FROM orders")
block("default_project", lambda: from_(O_) | o.default_project(O_.o_orderkey) | o.default_project(O_.o_custkey), "SELECT o_custkey FROM orders")
block("select_first_wins", lambda: from_(O_) | o.select(O_.o_orderkey) | o.select(O_.o_custkey), "SELECT o_orderkey FROM orders")
block("computed_column", lambda: from_(O_) | o.select(O_.o_orderkey, O_.o_totalprice.computed_by(f.func("round", O_.o_totalprice, 0))), "SELECT o_orderkey, round(o_totalprice, 0) AS o_totalprice FROM orders")

# predicates
for _name, _v, _sql in (
    ("eq", f.eq(5.0), "= 5"), ("neq", f.neq(5.0), "<> 5"), ("gt", f.gt(40.0), "> 40"), ("gte", f.gte(40.0), ">= 40"), ("lt", f.lt(10.0), "< 10"), ("lte", f.lte(10.0), "<= 10"),
    ("between", f.between(10.0, 20.0), "BETWEEN 10 AND 20"), ("not_between", f.not_between(10.0, 45.0), "NOT BETWEEN 10 AND 45"),
):
    block(f"where_{_name}", lambda v=_v: _pick(L, L.l_orderkey, L.l_partkey, L.l_quantity) | o.where(L.l_quantity, v), f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_sql}")
for _name, _v, _sql in (
    ("in", f.in_(1, 5, 9), "WHERE p_size IN (1, 5, 9)"), ("not_in", f.not_in(1, 5, 9), "WHERE p_size NOT IN (1, 5, 9)"), ("in_empty", f.in_(), ""), ("not_in_empty", f.not_in(), ""),
    ("in_seq_empty", f.in_seq([]), "WHERE false"), ("not_in_seq_empty", f.not_in_seq([]), ""), ("in_seq", f.in_seq(range(3)), "WHERE p_size IN (0, 1, 2)"),
):
    block(f"where_{_name}", lambda v=_v: _pick(P, P.p_partkey, P.p_size) | o.where(P.p_size, v), f"SELECT p_partkey, p_size FROM part {_sql}")
for _name, _v, _sql in (("like", f.like("l_r"), "LIKE '%l_r%'"), ("not_like", f.not_like("in"), "NOT LIKE '%in%'"), ("left_like", f.left_like("ring"), "LIKE '%ring'"), ("right_like", f.right_like("small"), "LIKE 'small%'")):
    block(f"where_{_name}", lambda v=_v: _pick(P, P.p_partkey, P.p_name) | o.where(P.p_name, v), f"SELECT p_partkey, p_name FROM part WHERE p_name {_sql}")
_AL = LABELS.with_name("lab")
for _name, _v, _sql in (("is_null", f.is_null(), "IS NULL"), ("is_not_null", f.is_not_null(), "IS NOT NULL")):
    block(f"where_{_name}", lambda v=_v: from_(D) | o.left_join_on(D.doc_id, _AL.doc_id, all_rows=True) | o.cast_where(_AL.doc_id, v) | o.select(D.doc_id, _AL.quality), f"SELECT d.doc_id AS documents__doc_id, l.quality AS lab__quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id {_sql}")
block("eq_col", lambda: _pick(L, L.l_orderkey, L.l_partkey) | o.where(L.l_linenumber, f.eq_col(L.l_quantity)), "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = l_quantity")
block("neq_col", lambda: _pick(L, L.l_orderkey, L.l_partkey) | o.where(L.l_returnflag, f.neq_col(L.l_linestatus)) | o.where(L.l_quantity, f.lt(5.0)), "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> l_linestatus AND l_quantity < 5")
block("or_where_fold", lambda: _pick(O_, O_.o_orderkey) | o.where(O_.o_orderstatus, f.eq("F")) | o.or_where(O_.o_orderstatus, f.eq("P")) | o.where(O_.o_totalprice, f.gt(100000.0)), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 100000")
block("and_or_fold", lambda: _pick(O_, O_.o_orderkey) | o.where(O_.o_orderstatus, f.eq("F")) | o.where(O_.o_totalprice, f.gt(100000.0)) | o.or_where(O_.o_orderkey, f.lt(50)), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderkey < 50")
block("xor_cond", lambda: _pick(O_, O_.o_orderkey) | o.where_cond(f.xor(f.on(O_.o_orderstatus, f.eq("F")), None, f.on(O_.o_totalprice, f.gt(100000.0)))), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 100000)")
block("optional_cond", lambda: _pick(O_, O_.o_orderkey) | o.where_cond(f.and_(None, f.on(O_.o_orderkey, f.in_()), f.or_(f.on(O_.o_orderkey, f.lt(9)), None))) | o.where_cond(None), "SELECT o_orderkey FROM orders WHERE o_orderkey < 9")
block("table_fragment", lambda: _pick(O_, O_.o_orderkey) | o.where_cond(f.raw(O_.fragment("#o_totalprice > ? AND #o_orderkey % 2 = 0", 100000.5))), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.5 AND o_orderkey % 2 = 0")

# subqueries in filters
_rich = lambda: from_(O_) | o.where(O_.o_orderstatus, f.eq("P")) | o.where(O_.o_totalprice, f.gt(200000.0))
_RICH = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000"
block("where_in_select", lambda: _pick(C, C.c_custkey) | o.where_in_select(C.c_custkey, O_.o_custkey, _rich()), f"SELECT c_custkey FROM customer WHERE c_custkey IN ({_RICH})")
block("where_not_in_select", lambda: _pick(C, C.c_custkey) | o.where_not_in_select(C.c_custkey, O_.o_custkey, _rich()), f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_RICH})")
block("where_in_select_or", lambda: _pick(C, C.c_custkey) | o.where(C.c_custkey, f.lt(20)) | o.where_in_select(C.c_custkey, O_.o_custkey, _rich(), op="or"), f"SELECT c_custkey FROM customer WHERE c_custkey < 20 OR c_custkey IN ({_RICH})")
block("nested_in_select", lambda: _pick(C, C.c_custkey) | o.where_in_select(C.c_nationkey, N.n_nationkey, from_(N) | o.where_in_select(N.n_regionkey, R.r_regionkey, from_(R) | o.where(R.r_name, f.gt("AS")))), "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name > 'AS'))")
block("in_select_limit", lambda: _pick(C, C.c_custkey) | o.where_in_select(C.c_custkey, O_.o_custkey, from_(O_) | o.asc_sort(O_.o_orderkey) | o.limit(40)), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 40)")
block("in_select_elided", lambda: _pick(C, C.c_custkey) | o.where_not_in_select(C.c_custkey, O_.o_custkey, from_(O_)), "SELECT c_custkey FROM customer")


@query("not_in_select_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, (SELECT min(o_custkey) FROM orders)) FROM orders)")
def _(spark, sf_dir, cat):
    found = cat.frame(O_).withColumn("o_custkey", F.nullif("o_custkey", F.lit(cat.frame(O_).agg(F.min("o_custkey")).first()[0])))
    sub = from_frame(O_, found) | o.where_cond(lambda at: F.lit(True))
    return compile_block(_pick(C, C.c_custkey) | o.where_not_in_select(C.c_custkey, O_.o_custkey, sub), cat)


# joins
_on = "orders.o_custkey = customer.c_custkey AND customer.c_mktsegment LIKE 'B%'"
for _how, _op in (("inner", o.join_on), ("left", o.left_join_on), ("right", o.right_join_on), ("full", o.full_join_on), ("cross", o.cross_join_on)):
    block(
        f"join_{_how}_on",
        lambda op=_op: from_(O_) | op(O_.o_custkey, C.c_custkey, o.where(C.c_mktsegment, f.right_like("B"))) | o.select(O_.o_orderkey, C.c_custkey),
        f"SELECT o_orderkey AS orders__o_orderkey, c_custkey AS customer__c_custkey FROM orders {'INNER' if _how == 'cross' else _how.upper()} JOIN customer ON {_on}",
    )
block("join_multi", lambda: from_(C) | o.join_on(C.c_nationkey, N.n_nationkey) | o.join_on_as(N.n_regionkey, R.r_regionkey, o.where(R.r_name, f.neq("ASIA"))) | o.select(C.c_custkey, N.n_name, R.r_name), "SELECT c_custkey AS customer__c_custkey, n_name AS nation__n_name, r_name AS region__r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
block("join_theta", lambda: from_(S) | o.join_cond(N, lambda at: (at(S.s_nationkey) < at(N.n_nationkey)) & (at(N.n_regionkey) == 1), "left") | o.select(S.s_suppkey, N.n_nationkey), "SELECT s_suppkey AS supplier__s_suppkey, n_nationkey AS nation__n_nationkey FROM supplier LEFT JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 1")
block("join_cross", lambda: from_(N) | o.join_cond(R) | o.select(N.n_name, R.r_name), "SELECT n_name AS nation__n_name, r_name AS region__r_name FROM nation CROSS JOIN region")
block("join_using", lambda: from_(D) | o.join_cond(_AL, using=("doc_id",), all_rows=True) | o.select(D.lang, _AL.quality), "SELECT lang AS documents__lang, quality AS lab__quality FROM documents JOIN labels USING (doc_id)")
_N2 = NATION.with_name("other")
block("join_self", lambda: from_(N) | o.join_on(N.n_regionkey, _N2.n_regionkey) | o.select(N.n_name, _N2.n_name), "SELECT a.n_name AS nation__n_name, b.n_name AS other__n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")

# soft delete
block("soft_delete_from", lambda: from_(LB), "SELECT * FROM labels WHERE toxic = 0")
block("soft_delete_from_all", lambda: from_all(LB), "SELECT * FROM labels")
block("soft_delete_join", lambda: from_(D) | o.left_join_on(D.doc_id, LB.doc_id) | o.select(D.doc_id, LB.quality), "SELECT d.doc_id AS documents__doc_id, l.quality AS labels__quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")
block("soft_delete_right_join", lambda: from_(LB) | o.right_join_on(LB.doc_id, D.doc_id) | o.select(LB.quality, D.doc_id), "SELECT l.quality AS labels__quality, d.doc_id AS documents__doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 0")

# aggregates
block("agg_global", lambda: o.aggregate(from_(O_), f.count().as_("n"), as_double(money("o_totalprice"), "total"), f.min_(O_.o_totalprice).as_("low"), f.max_(O_.o_totalprice).as_("high")), "SELECT count(1) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
block("agg_group", lambda: o.aggregate_group_by(from_(L), [L.l_returnflag, L.l_linestatus], L.l_returnflag, L.l_linestatus, f.count().as_("n"), as_double(money("l_quantity"), "quantity")), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY ALL")


def _having() -> Block:
    grouped = o.aggregate_group_by(from_(O_), [O_.o_custkey], O_.o_custkey, f.count().as_("n"))
    return grouped | o.where(grouped.model.n, f.gt(12)) | o.desc_sort(grouped.model.n) | o.asc_sort(grouped.model.o_custkey) | o.limit(50)


block("agg_having", _having, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 ORDER BY n DESC, o_custkey LIMIT 50")
block("agg_over_subquery", lambda: o.aggregate(from_(O_) | o.asc_sort(O_.o_orderkey) | o.limit(100), f.count().as_("n"), f.max_(O_.o_orderkey).as_("top")), "SELECT count(*) AS n, max(o_orderkey) AS top FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)")
block("agg_soft_delete", lambda: o.aggregate_group_by(from_(LB), [LB.quality], LB.quality, f.count().as_("n")), "SELECT quality, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY quality")
block("agg_all_fns", lambda: o.aggregate_group_by(from_(P), [P.p_brand], P.p_brand, f.count(P.p_size).as_("n"), f.sum_(P.p_size.fragment("CAST(# AS BIGINT)")).as_("total"), f.func("round", f.avg(P.p_size), 6).as_("mean"), f.min_(P.p_size).as_("low"), f.max_(P.p_size).as_("high")), "SELECT p_brand, count(p_size) AS n, sum(p_size)::BIGINT AS total, round(avg(p_size), 6) AS mean, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand")
block("count_distinct", lambda: o.aggregate_group_by(from_(L), [L.l_returnflag], L.l_returnflag, f.count(f.distinct(L.l_suppkey)).as_("n")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
block("any_value", lambda: o.aggregate_group_by(from_(N), [N.n_nationkey], N.n_nationkey, f.any_value(N.n_name).as_("name")), "SELECT n_nationkey, any_value(n_name) AS name FROM nation GROUP BY n_nationkey")
block("first_last", lambda: o.aggregate_group_by(from_(E), [E.user_id], E.user_id, f.first(E.event_type, E.event_id).as_("first_type"), f.last(E.event_type, E.event_id).as_("last_type")), "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
block("func_by_name", lambda: from_(C) | o.select(C.c_custkey, f.func("upper", C.c_mktsegment).as_("segment"), f.func("length", C.c_name).as_("n")), "SELECT c_custkey, upper(c_mktsegment) AS segment, length(c_name)::INT AS n FROM customer")

# order and pages
_sorted = lambda: _pick(O_, O_.o_orderkey, O_.o_totalprice) | o.desc_sort(O_.o_totalprice) | o.asc_sort(O_.o_orderkey)
_SORTED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
block("sort_limit", lambda: _sorted() | o.limit(25), f"{_SORTED} LIMIT 25")
block("sort_limit_offset", lambda: _sorted() | o.limit(25, 10), f"{_SORTED} LIMIT 25 OFFSET 10")
block("limit_then_where", lambda: _sorted() | o.limit(25) | o.where(O_.o_orderstatus, f.eq("F")), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
block("limit_zero", lambda: _sorted() | o.limit(0, 5), "SELECT o_orderkey, o_totalprice FROM orders")
block("limit_last_wins", lambda: _sorted() | o.limit(5) | o.limit(7) | o.limit(-1), f"{_SORTED} LIMIT 7")
block("top_k_multi_key", lambda: _pick(P, P.p_partkey) | o.asc_sort(P.p_brand) | o.desc_sort(P.p_size) | o.asc_sort(P.p_partkey) | o.limit(30), "SELECT p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 30")
block("sort_nulls", lambda: from_(D) | o.left_join_on(D.doc_id, _AL.doc_id, all_rows=True) | o.select(D.doc_id, _AL.quality) | o.cast_asc_sort(_AL.quality, "last") | o.asc_sort(D.doc_id), "SELECT d.doc_id AS documents__doc_id, l.quality AS lab__quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS LAST, d.doc_id")
block("distinct", lambda: _pick(E, E.event_type) | o.distinct(), "SELECT DISTINCT event_type FROM events")
block("distinct_on_sorted", lambda: _pick(E, E.user_id, E.event_id, E.event_type) | o.distinct_on(E.user_id) | o.desc_sort(E.event_id), "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, event_id DESC")
block("distinct_on_nested_limit", lambda: _pick(O_, O_.o_custkey, O_.o_orderkey) | o.distinct_on(O_.o_custkey) | o.desc_sort(O_.o_orderkey) | o.limit(20), "SELECT o_custkey, o_orderkey FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC) ORDER BY o_orderkey DESC LIMIT 20")
block("distinct_on_key", lambda: _pick(E, E.user_id) | o.distinct_on(E.user_id), "SELECT DISTINCT user_id FROM events")
block("as_subquery_then_where", lambda: as_(from_(O_) | o.asc_sort(O_.o_orderkey) | o.limit(200), "t") | o.where(O_.o_orderstatus, f.eq("F")) | o.select(O_.o_orderkey), "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200) WHERE o_orderstatus = 'F'")

# set operations
for _name, _op in (("union", o.union), ("intersect", o.intersect), ("except", o.except_)):
    for _all in (True, False):
        block(f"{_name}_{'all' if _all else 'distinct'}", lambda op=_op, a=_all: _pick(C, C.c_nationkey) | o.where(C.c_nationkey, f.lt(15)) | op(_pick(S, S.s_nationkey) | o.where(S.s_nationkey, f.gt(5)), a), f"SELECT c_nationkey FROM customer WHERE c_nationkey < 15 {_name.upper()} {'ALL ' if _all else ''}SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
block("union_sorted_limit", lambda: _pick(C, C.c_custkey) | o.union(_pick(S, S.s_suppkey)) | o.desc_sort(C.c_custkey) | o.limit(10), "SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY 1 DESC LIMIT 10")


# common table expressions
@query("cte_simple", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, o_totalprice FROM big WHERE o_custkey < 500")
def _(spark, sf_dir, cat):
    big = Model.of("big", "o_custkey long, o_totalprice double")
    return with_(big, lambda: _pick(O_, O_.o_custkey, O_.o_totalprice) | o.where(O_.o_totalprice, f.gt(200000.0))).exec(lambda: from_(big) | o.where(big.o_custkey, f.lt(500)), cat)


@query("cte_two", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), b AS (SELECT k FROM a WHERE k > 2) SELECT c_custkey AS customer__c_custkey, k AS b__k FROM customer JOIN b ON c_nationkey = k")
def _(spark, sf_dir, cat):
    a, b = Model.of("a", "k int"), Model.of("b", "k int")
    both = with_(a, lambda: _pick(N, N.n_nationkey) | o.where(N.n_regionkey, f.eq(1))).with_(b, lambda: from_(a) | o.where(a.k, f.gt(2)))
    return both.exec(lambda: from_(C) | o.join_on(C.c_nationkey, b.k) | o.select(C.c_custkey, b.k), cat)


_TURNS = "SELECT conv_id, turn, CAST(0 AS INT) AS depth FROM {0} WHERE turn = 0 UNION ALL SELECT t.conv_id, t.turn, r.depth + 1 FROM {0} t JOIN r ON t.conv_id = r.conv_id AND t.turn = r.turn + 1"


@query("cte_recursive_depth", f"WITH RECURSIVE r(conv_id, turn, depth) AS ({_TURNS.format('conversations')}) SELECT conv_id, max(depth) AS depth, count(*) AS n FROM r GROUP BY conv_id")
def _(spark, sf_dir, cat):
    return with_recursive(spark, "r", ["conv_id", "turn", "depth"], _TURNS.format("turns"), "SELECT conv_id, max(depth) AS depth, count(*) AS n FROM r GROUP BY conv_id", {"turns": cat.frame(CONVERSATIONS)}, 1000)


# executor
@query("count_verb_ignores_limit", "SELECT count(*) AS count FROM orders WHERE o_totalprice < 100000")
def _(spark, sf_dir, cat):
    return Executor(from_(O_), cat).pipe(o.limit(10), o.where(O_.o_totalprice, f.lt(100000.0))).count_frame()


@query("find_one", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1")
def _(spark, sf_dir, cat):
    return Executor(from_(O_), cat).pipe(o.limit(1), o.asc_sort(O_.o_orderkey), o.select(O_.o_orderkey)).frame()


# mini-languages
block("filter_dsl_and", lambda: _pick(P, P.p_partkey) | filters.as_where(P.p_size, "and(gte(5),lte(10))"), "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size <= 10")
block("filter_dsl_or_where", lambda: _pick(P, P.p_partkey) | filters.compose({"part.brand": P.p_brand, "part.size": P.p_size}, 'or(where("part.brand",prefix("Brand#1")),where("part.size",in(1,2,3,4)))').operator(), "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_size IN (1, 2, 3, 4)")
block("filter_dsl_in_prefix", lambda: _pick(P, P.p_partkey) | filters.indexed_filters(P, "part")["part~pBrand"]('or(prefix("Brand#2"),suffix("5"),in("Brand#11"))'), "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#2%' OR p_brand LIKE '%5' OR p_brand IN ('Brand#11')")
block("filter_dsl_intersection", lambda: _pick(P, P.p_partkey) | filters.as_where(P.p_size, "intersection(in(1,2,3,4),in(3,4,5),neq(-4))"), "SELECT p_partkey FROM part WHERE p_size IN (3, 4)")
block("sort_dsl", lambda: _pick(O_, O_.o_orderkey) | sorts.By.parse("order~key!desc").operator({"order~key": O_.o_orderkey}) | o.limit(5), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")

# mutations: the table's content afterwards, or the rows affected
_NEW = [{"r_regionkey": 3, "r_name": "NEW"}, {"r_regionkey": 77, "r_name": "ATLANTIS"}]
_ROWS = "(VALUES (3, 'NEW'), (77, 'ATLANTIS')) AS v(r_regionkey, r_name)"


@query("values_insert", f"SELECT * FROM region UNION ALL SELECT * FROM {_ROWS}")
def _(spark, sf_dir, cat):
    return m.apply(cat.frame(R), values(spark, R, _NEW), cat).after


@query("insert_from", "SELECT s_nationkey AS n_nationkey, s_name AS n_name, s_nationkey AS n_regionkey FROM supplier WHERE s_acctbal > 5000")
def _(spark, sf_dir, cat):
    return insert_from(from_(S) | o.where(S.s_acctbal, f.gt(5000.0)) | o.select(S.s_nationkey, S.s_name, S.s_nationkey), N, N.n_nationkey, N.n_name, N.n_regionkey, catalog=cat)


@query("upsert_do_nothing", f"SELECT * FROM region UNION ALL SELECT * FROM {_ROWS} WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")
def _(spark, sf_dir, cat):
    return m.apply(cat.frame(R), values(spark, R, _NEW) | m.on_conflict_do_nothing(R.r_regionkey), cat).after


@query("upsert_do_update", f"SELECT r.r_regionkey, coalesce(v.r_name, r.r_name) AS r_name FROM region r LEFT JOIN {_ROWS} USING (r_regionkey) UNION ALL SELECT * FROM {_ROWS} WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")
def _(spark, sf_dir, cat):
    return m.apply(cat.frame(R), values(spark, R, _NEW) | m.on_conflict_do_update_set([R.r_regionkey], R.r_name), cat).after


@query("upsert_do_with", f"SELECT r.r_regionkey, r.r_name || coalesce('+' || v.r_name, '') AS r_name FROM region r LEFT JOIN {_ROWS} USING (r_regionkey) UNION ALL SELECT * FROM {_ROWS} WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")
def _(spark, sf_dir, cat):
    return m.apply(cat.frame(R), values(spark, R, _NEW) | m.on_conflict_do_with([R.r_regionkey], lambda old, new: {"r_name": F.concat_ws("+", old("r_name"), new("r_name"))}), cat).after


def _changed(name: str, model: Model, sql: str, *ops: Callable, affected: bool = False, every: bool = False, now: object = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cat = catalog(spark, sf_dir)
        out = m.apply(cat.frame(model), (from_all if every else from_)(model).pipe(*ops), cat, now)
        return out.affected if affected else out.after

    QUERIES[name], SQL[name] = run, sql


_POOR = "s_acctbal < 0"
_changed("update_set", S, f"SELECT s_suppkey, CASE WHEN {_POOR} THEN 'poor' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier", o.where(S.s_acctbal, f.lt(0.0)), m.do_update(S.s_name, f.value("poor")))
_changed("update_incr", S, f"SELECT s_suppkey, s_name, CASE WHEN {_POOR} THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, CASE WHEN {_POOR} THEN 0 ELSE s_acctbal END::DOUBLE AS s_acctbal FROM supplier", o.where(S.s_acctbal, f.lt(0.0)), m.do_update(S.s_nationkey, f.incr(1)), m.do_update(S.s_acctbal, f.value(0.0)))
_changed("update_set_row", N, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation", o.where(N.n_regionkey, f.eq(1)), m.do_update_set_omit_zero(N, {"n_nationkey": 0, "n_name": "x", "n_regionkey": 0}))
_changed("returning_update", S, f"SELECT s_suppkey, 'poor' AS s_name FROM supplier WHERE {_POOR}", o.where(S.s_acctbal, f.lt(0.0)), m.do_update(S.s_name, f.value("poor")), o.returning(S.s_suppkey, S.s_name), affected=True)
_changed("delete_hard_postimage", S, f"SELECT * FROM supplier WHERE NOT ({_POOR})", o.where(S.s_acctbal, f.lt(0.0)), m.do_delete_hard())
_changed("delete_soft_postimage", LB, "SELECT doc_id, quality, CASE WHEN toxic = 0 AND quality = 0 THEN 1700000000 ELSE toxic END::INT AS toxic FROM labels", o.where(LB.quality, f.eq(0)), m.do_delete(), every=True, now=1700000000)
_changed("delete_hard_live_only", LB, "SELECT * FROM labels WHERE NOT (toxic = 0 AND quality = 0)", o.where(LB.quality, f.eq(0)), m.do_delete_hard())


@query("update_from", "SELECT s_suppkey, CASE WHEN n.n_nationkey IS NOT NULL THEN n_name ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier LEFT JOIN nation n ON s_nationkey = n_nationkey AND n_regionkey = 2")
def _(spark, sf_dir, cat):
    other = cat.frame(N).where("n_regionkey = 2").withColumnRenamed("n_nationkey", "s_nationkey")
    return m.update_from(cat.frame(S), other, ["s_nationkey"], {"s_name": lambda a, b: b("n_name")}).after


# keyed sets, codecs, migration
@query("one_to_multi", "SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def _(spark, sf_dir, cat):
    out = one_to_multi(cat.frame(O_).select("o_custkey", "o_orderkey"), "o_custkey")
    keys = F.array_sort(F.transform("records", lambda r: r["o_orderkey"]))
    return out.select("o_custkey", F.size("records").cast("long").alias("n"), F.array_join(keys, ",").alias("keys"))


@query("first_records", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, sf_dir, cat):
    return first_records(cat.frame(O_).select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("json_props", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def _(spark, sf_dir, cat):
    return cat.frame(E).select("event_id", types.from_json(F.col("props"), "k long")["k"].alias("k"))


@query("timestamp_seconds", "SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events")
def _(spark, sf_dir, cat):
    return cat.frame(E).select("event_id", types.seconds(F.col("ts")).alias("s"))


@query("add_date", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + ((day(o_orderdate) - 1) * INTERVAL 1 DAY), '%Y-%m-%d') AS d FROM orders")
def _(spark, sf_dir, cat):
    return cat.frame(O_).select("o_orderkey", F.date_format(types.add_date(F.col("o_orderdate"), 0, 1, 0), "yyyy-MM-dd").alias("d"))


@query("duration_parse", "SELECT * FROM (VALUES ('1wk', 604800000000000), ('1  minute', 60000000000), ('1h30m', 5400000000000), ('2milliseconds', 2000000), ('x', NULL)) AS t(text, ns)")
def _(spark, sf_dir, cat):
    return spark.createDataFrame([("1wk",), ("1  minute",), ("1h30m",), ("2milliseconds",), ("x",)], "text string").withColumn("ns", types.duration_ns(F.col("text")))


@query("tri_bool", "SELECT doc_id, CASE WHEN toxic IS NULL THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS flag FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf_dir, cat):
    return cat.frame(D).join(cat.frame(LB), "doc_id", "left").select("doc_id", types.from_bool(F.col("toxic") == 1).alias("flag"))


@query("migrate_add_rename_modify", "SELECT s_suppkey, s_name AS s_title, s_nationkey::BIGINT AS s_nationkey, 7 AS s_rank FROM supplier")
def _(spark, sf_dir, cat):
    to = Model("supplier", (Col("s_suppkey", "long"), Col("s_name", deprecated="s_title"), Col("s_title"), Col("s_nationkey", "long"), Col("s_acctbal", "double", deprecated=True), Col("s_rank", "int", default=7)))
    return migrated(cat.frame(S), diff(SUPPLIER, to)).select("s_suppkey", "s_title", "s_nationkey", "s_rank")


# the flagship: live orders, joined and grouped
def _flagship() -> Block:
    big = from_(OPEN_ORDERS) | o.join_on(OPEN_ORDERS.o_custkey, C.c_custkey, o.where(C.c_acctbal, f.gt(0.0)))
    grouped = o.aggregate_group_by(big, [C.c_mktsegment], C.c_mktsegment, f.count().as_("n"), as_double(money("o_totalprice"), "total"))
    return grouped | o.desc_sort(grouped.model.total) | o.limit(10)


block("entry", _flagship, "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_orderstatus = 'O' GROUP BY c_mktsegment ORDER BY total DESC LIMIT 10")

from millrace import queries_api  # noqa: E402, F401  registers the rest
