"""Queries of the sequence algebra: each of its operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import ORDINAL, Sequence, with_ordinal
from .registry import query
from .tables import load


def seq(spark: SparkSession, sf_dir: str, name: str, *order: str) -> Sequence:
    return Sequence(load(spark, sf_dir, name), list(order))


def _at(spark: SparkSession, sf_dir: str) -> Sequence:
    """Events by time."""
    return seq(spark, sf_dir, "events", "ts", "event_id")


def _listed(array: str | None = "elements"):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# ---- restriction and projection ----


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
def where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return s.where((F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05)).df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 10 = 3""")
def where_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq(spark, sf_dir, "orders", "o_orderkey").where(lambda i: i % 10 == 3).df.select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return s.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).df


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx, o_orderkey FROM orders")
def select_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq(spark, sf_dir, "orders", "o_orderkey").select(lambda i: i.alias("idx"), F.col("o_orderkey")).df.select("idx", "o_orderkey")


@query("SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS quantity, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").cast(l_quantity="int", l_linenumber="string")
    return s.df.select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"))


@query("SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _at(spark, sf_dir)
    return events.of_type("event_type", events.fold(F.min("event_type"))).df.select("event_id", "user_id")


# ---- sets ----



def _nation_keys(spark: SparkSession, sf_dir: str) -> tuple[Sequence, Sequence]:
    c = seq(spark, sf_dir, "customer", "c_custkey")
    s = seq(spark, sf_dir, "supplier", "s_suppkey")
    a = Sequence(c.df.select("c_custkey", F.col("c_nationkey").alias("k")), ["c_custkey"])
    b = Sequence(s.df.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("k")), ["c_custkey"])
    return a, b


_PAIR = "a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)"


@query(f"WITH {_PAIR} SELECT k FROM a UNION ALL SELECT k FROM b")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nation_keys(spark, sf_dir)
    return a.concat(b).df.select("k")


@query(f"WITH {_PAIR} SELECT k FROM a UNION SELECT k FROM b")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nation_keys(spark, sf_dir)
    return a.union(b, F.col("k")).df.select("k")


@query(f"WITH {_PAIR} SELECT k FROM a EXCEPT SELECT k FROM b")
def except_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nation_keys(spark, sf_dir)
    return a.except_(b, F.col("k")).df.select("k")


@query(f"WITH {_PAIR} SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nation_keys(spark, sf_dir)
    return a.intersect(b, F.col("k")).df.select("k")


@query("SELECT DISTINCT event_type FROM events")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).distinct(F.col("event_type")).df.select("event_type")


_SMALL, _LARGE, _DEAR = "p_size <= 20", "p_size > 20", "p_size >= 46 AND p_type = 'PROMO'"
_CASED = "CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END"


def _brands(spark: SparkSession, sf_dir: str, keep: str) -> Sequence:
    return Sequence(load(spark, sf_dir, "part").filter(keep).select("p_partkey", F.expr(_CASED).alias("brand")), ["p_partkey"])


_BRANDS = f"p AS (SELECT p_partkey, p_size, p_type, {_CASED} AS brand FROM part)"
_FIRST = "SELECT p_partkey, brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(brand) ORDER BY {order}) AS n FROM {src}) WHERE n = 1"


@query(f"WITH {_BRANDS} {_FIRST.format(order='p_partkey', src='p')}")
def distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir, "true").distinct(F.lower("brand")).df.select("p_partkey", "brand")


@query(f"""WITH {_BRANDS}, u AS (SELECT 0 AS br, * FROM p WHERE {_SMALL} UNION ALL SELECT 1, * FROM p WHERE {_LARGE})
{_FIRST.format(order="br, p_partkey", src="u")}""")
def union_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _brands(spark, sf_dir, _SMALL), _brands(spark, sf_dir, _LARGE)
    return a.union(b, F.lower("brand")).df.select("p_partkey", "brand")


@query(f"""WITH {_BRANDS}, a AS (SELECT * FROM p WHERE {_SMALL}), f AS ({_FIRST.format(order="p_partkey", src="a")})
SELECT p_partkey, brand FROM f WHERE lower(brand) NOT IN (SELECT lower(brand) FROM p WHERE {_DEAR})""")
def except_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _brands(spark, sf_dir, _SMALL), _brands(spark, sf_dir, _DEAR)
    return a.except_(b, F.lower("brand")).df.select("p_partkey", "brand")


@query(f"""WITH {_BRANDS}, a AS (SELECT * FROM p WHERE {_SMALL}), f AS ({_FIRST.format(order="p_partkey", src="a")})
SELECT p_partkey, brand FROM f WHERE lower(brand) IN (SELECT lower(brand) FROM p WHERE {_DEAR})""")
def intersect_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _brands(spark, sf_dir, _SMALL), _brands(spark, sf_dir, _DEAR)
    return a.intersect(b, F.lower("brand")).df.select("p_partkey", "brand")


# ---- groups ----


def _orders(spark: SparkSession, sf_dir: str) -> Sequence:
    return seq(spark, sf_dir, "orders", "o_orderkey")


@query("""SELECT o_custkey AS key, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS elements FROM orders GROUP BY o_custkey""")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _orders(spark, sf_dir).group_by(F.col("o_custkey"))
    return g.select("key", F.array_join(F.transform("elements", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("elements"))


@query("SELECT o_custkey AS key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS elements FROM orders GROUP BY o_custkey")
def group_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).group_by(F.col("o_custkey"), F.col("o_orderkey")).select("key", _listed().alias("elements"))


@query("""SELECT l_returnflag AS key, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_returnflag""")
def group_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return s.group_by(F.col("l_returnflag"), result=[F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty")])


@query("""SELECT o_orderstatus AS key, max(o_totalprice) AS top, min(o_orderdate) AS since FROM orders GROUP BY o_orderstatus""")
def group_element_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).group_by(F.col("o_orderstatus"), result=[F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("since")])


_GROUP_CI = f"""WITH {_BRANDS}, g AS (SELECT *, first_value(brand) OVER (PARTITION BY lower(brand) ORDER BY p_partkey) AS key FROM p)"""


@query(f"{_GROUP_CI} SELECT key, string_agg(p_partkey || ':' || brand, ',' ORDER BY p_partkey) AS elements FROM g GROUP BY key")
def group_rows_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _brands(spark, sf_dir, "true").group_by(F.col("brand"), equal=F.lower)
    return g.select("key", F.array_join(F.transform("elements", lambda x: F.concat_ws(":", x["p_partkey"].cast("string"), x["brand"])), ",").alias("elements"))


@query(f"{_GROUP_CI} SELECT key, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS elements FROM g GROUP BY key")
def group_element_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir, "true").group_by(F.col("brand"), F.col("p_partkey"), equal=F.lower).select("key", _listed().alias("elements"))


@query(f"{_GROUP_CI} SELECT key, count(*) AS n FROM g GROUP BY key")
def group_result_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir, "true").group_by(F.col("brand"), result=[F.count(F.lit(1)).alias("n")], equal=F.lower)


@query(f"{_GROUP_CI} SELECT key, CAST(sum(p_partkey) AS BIGINT) AS total FROM g GROUP BY key")
def group_element_result_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir, "true").group_by(F.col("brand"), result=[F.sum("p_partkey").alias("total")], equal=F.lower)


# ---- joins ----


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey"), F.col("c_custkey")).select("o_orderkey", "c_name")


@query(f"""WITH {_BRANDS} SELECT a.p_partkey, b.p_partkey AS other FROM p a JOIN p b ON lower(a.brand) = lower(b.brand) WHERE a.p_size <= 20 AND b.p_size >= 46 AND b.p_type = 'PROMO'""")
def join_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _brands(spark, sf_dir, _SMALL), _brands(spark, sf_dir, _DEAR)
    inner = b.df.select(F.col("p_partkey").alias("other"), F.col("brand").alias("other_brand"))
    return a.join(inner, F.col("brand"), F.col("other_brand"), equal=F.lower).select("p_partkey", "other")


@query("""SELECT c_custkey, coalesce(m, '') AS matches FROM customer LEFT JOIN
(SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = seq(spark, sf_dir, "customer", "c_custkey").group_join(_orders(spark, sf_dir), F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderkey"))
    return g.select("c_custkey", _listed("matches").alias("matches"))


@query(f"""WITH {_BRANDS} SELECT p_partkey, coalesce(m, '') AS matches FROM p LEFT JOIN
(SELECT lower(brand) AS k, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS m FROM p WHERE {_DEAR} GROUP BY 1) ON k = lower(brand) WHERE {_SMALL}""")
def group_join_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _brands(spark, sf_dir, _SMALL), _brands(spark, sf_dir, _DEAR)
    return a.group_join(b, F.col("brand"), F.col("brand"), F.col("p_partkey"), equal=F.lower).select("p_partkey", _listed("matches").alias("matches"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq(spark, sf_dir, "nation", "n_nationkey").select_many_from(load(spark, sf_dir, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


# ---- order: the position is part of the result so that it can be compared ----


def _numbered(s: Sequence, *columns: str) -> DataFrame:
    return with_ordinal(s.df, s.order, "rn").select("rn", *columns)


def _rn(order: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS rn, o_orderkey FROM orders"


@query(_rn("o_totalprice, o_orderkey"))
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_totalprice")), "o_orderkey")


@query(_rn("o_orderpriority DESC, o_orderkey"))
def order_by_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_orderpriority"), descending=True), "o_orderkey")


@query(_rn("o_custkey % 7, o_orderkey"))
def order_by_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_custkey") % 7), "o_orderkey")


@query(_rn("o_custkey % 7 DESC, o_orderkey"))
def order_by_desc_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_custkey") % 7, descending=True), "o_orderkey")


@query(_rn("o_orderstatus, o_orderdate, o_orderkey"))
def then_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_orderstatus")).then_by(F.col("o_orderdate")), "o_orderkey")


@query(_rn("o_orderstatus, o_orderdate DESC, o_orderkey"))
def then_by_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_orderstatus")).then_by(F.col("o_orderdate"), descending=True), "o_orderkey")


@query(_rn("o_orderstatus, length(o_orderpriority), o_orderkey"))
def then_by_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_orderstatus")).then_by(F.length("o_orderpriority")), "o_orderkey")


@query(_rn("o_orderstatus, length(o_orderpriority) DESC, o_orderkey"))
def then_by_desc_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).order_by(F.col("o_orderstatus")).then_by(F.length("o_orderpriority"), descending=True), "o_orderkey")


@query(_rn("o_orderkey DESC"))
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_orders(spark, sf_dir).reverse(), "o_orderkey")


# ---- slices ----


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).take(100).df.select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id OFFSET 100")
def skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).skip(100).df.select("event_id")


_WHILE = """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, {test} AS ok FROM events),
s AS (SELECT min(i) AS stop FROM e WHERE NOT ok) SELECT event_id FROM e, s WHERE {keep}"""
_LEADING, _REST = "stop IS NULL OR i < stop", "i >= stop"


@query(_WHILE.format(test="value < 90", keep=_LEADING))
def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).take_while(F.col("value") < 90).df.select("event_id")


@query(_WHILE.format(test="value < 90", keep=_REST))
def skip_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).skip_while(F.col("value") < 90).df.select("event_id")


@query(_WHILE.format(test="value < 90 OR row_number() OVER (ORDER BY ts, event_id) - 1 < 20", keep=_LEADING))
def take_while_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).take_while(lambda i: (F.col("value") < 90) | (i < 20)).df.select("event_id")


@query(_WHILE.format(test="value < 90 OR row_number() OVER (ORDER BY ts, event_id) - 1 < 20", keep=_REST))
def skip_while_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir).skip_while(lambda i: (F.col("value") < 90) | (i < 20)).df.select("event_id")


# ---- flattening ----


def _documents(spark: SparkSession, sf_dir: str) -> Sequence:
    return Sequence(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line"


@query(f"{_LINES} FROM documents")
def select_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select_many(F.split("text", "\n", -1), "line").df.select("doc_id", "line")


@query("""SELECT idx, line FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, text FROM documents), LATERAL (SELECT unnest(string_split(text, chr(10))) AS line)""")
def select_many_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select_many(F.split("text", "\n", -1), "line").df.select(F.col(ORDINAL).alias("idx"), "line")


@query("SELECT doc_id, CAST(length(line) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def select_many_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select_many(F.split("text", "\n", -1), "line").df.select("doc_id", F.length("line").cast("long").alias("n"))


@query("""SELECT idx, CAST(pos - 1 AS BIGINT) AS place, CAST(length(parts[pos]) AS BIGINT) AS n FROM
(SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos)""")
def select_many_indexed_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _documents(spark, sf_dir).select_many(F.split("text", "\n", -1), "line", position="place")
    return s.df.select(F.col(ORDINAL).alias("idx"), F.col("place").cast("long").alias("place"), F.length("line").cast("long").alias("n"))


@query("""SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
JOIN (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem) USING (i)""")
def zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return _orders(spark, sf_dir).zip(items).select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT * FROM (VALUES (CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR))) t(c_custkey, c_name)")
def default_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sequence(load(spark, sf_dir, "customer").select("c_custkey", "c_name").filter("c_custkey < 0"), ["c_custkey"])
    return s.default_if_empty().df


@query("""SELECT 'some' AS kind, c_custkey, c_name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'none', -1, 'nobody'""")
def default_if_empty_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence with rows and one without."""
    own = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    some, none = (Sequence(own.filter(f).select("c_custkey", "c_name"), ["c_custkey"]).default_if_empty(c_custkey=-1, c_name="nobody").df for f in ("c_acctbal > 9000", "c_acctbal > 1e9"))
    return some.select(F.lit("some").alias("kind"), "*").unionByName(none.select(F.lit("none").alias("kind"), "*"))


# ---- terminals as one-row tables ----


@query("""SELECT count(*) AS n, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS n_big, bool_or(l_discount = 0) AS any_free, bool_and(l_quantity > 0) AS all_positive,
min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean,
bool_or(l_returnflag = 'R') AS has_r FROM lineitem""")
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, Any, All, Min, Max, Sum, Average and Contains."""
    s = seq(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    row = (
        s.count(), s.count(F.col("l_quantity") > 25), s.any(F.col("l_discount") == 0), s.all(F.col("l_quantity") > 0), s.fold(F.min("l_shipdate")), s.fold(F.max("l_shipdate")),
        s.fold(F.sum(F.col("l_quantity").cast("long"))), s.fold(F.round(F.avg("l_quantity"), 6)), s.contains(F.col("l_returnflag"), "R"),
    )
    return spark.createDataFrame([row], "n long, n_big long, any_free boolean, all_positive boolean, first_ship timestamp_ntz, last_ship timestamp_ntz, total long, mean double, has_r boolean")


@query("""SELECT (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1) AS first_id, (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_id,
(SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 41) AS at_41, (SELECT max(event_id) FROM events) AS only_id, (SELECT count(*) FROM region) AS listed, CAST(0 AS BIGINT) AS nothing""")
def first_last_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, Last, ElementAt, Single and ToList, and the empty sequence."""
    s = _at(spark, sf_dir)
    only = s.single(F.col("event_id") == s.fold(F.max("event_id")))
    listed = seq(spark, sf_dir, "region", "r_regionkey").to_list()
    nothing = Sequence.of(spark, [], "x int")
    row = (s.first()["event_id"], s.last()["event_id"], s.element_at(41)["event_id"], only["event_id"], len(listed), nothing.count() + len(nothing.to_list()) + int(nothing.first_or_none() is not None))
    return spark.createDataFrame([row], "first_id long, last_id long, at_41 long, only_id long, listed long, nothing long")


@query("SELECT true AS equal_to_itself, false AS equal_without_last, false AS equal_to_reversed, false AS equal_to_changed")
def sequence_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the same rows from another order, without the last row, the other way round and with one changed value."""
    s = _orders(spark, sf_dir)
    own = Sequence(s.df.select("o_orderkey", "o_custkey"), ["o_orderkey"])
    last = own.fold(F.max("o_orderkey"))
    changed = own.df.withColumn("o_custkey", F.when(F.col("o_orderkey") == last, -1).otherwise(F.col("o_custkey")))
    others = [Sequence(own.df.orderBy(F.desc("o_orderkey")), ["o_orderkey"]), own.where(F.col("o_orderkey") < last), own.reverse(), Sequence(changed, ["o_orderkey"])]
    names = ("itself", "without_last", "reversed", "changed")
    return spark.createDataFrame([tuple(own.sequence_equal(o) for o in others)], ", ".join(f"equal_{'without_last' if n == 'without_last' else 'to_' + n} boolean" for n in names))
