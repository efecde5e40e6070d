"""Queries of the graph and repository operators, on tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.durable import written
from ..operators.sequence import By, with_ordinal
from .registry import query
from .tables import load

# ---- a commit graph of events: an event's first parent is the user's event before it, its second, where its id is a
# multiple of 7, the latest event before it that another user has ----

_DAG = """p AS (SELECT event_id AS id, user_id AS u, ts, floor(epoch(ts))::BIGINT AS epoch, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mine,
lag(event_id) OVER (ORDER BY ts, event_id) AS last, lag(user_id) OVER (ORDER BY ts, event_id) AS last_u FROM events),
q AS (SELECT *, sum(CASE WHEN last_u IS DISTINCT FROM u THEN 1 ELSE 0 END) OVER (ORDER BY ts, id) AS run FROM p),
n AS (SELECT *, first_value(last) OVER (PARTITION BY run ORDER BY ts, id) AS other FROM q),
e AS (SELECT id AS commit_id, 0 AS parent_index, mine AS parent_id FROM n WHERE mine IS NOT NULL UNION ALL SELECT id, 1, other FROM n WHERE id % 7 = 0 AND other IS NOT NULL)"""


def _commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, u, epoch) and edges (commit_id, parent_index, parent_id)."""
    epoch = F.expr("CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)")
    n = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), "ts", epoch.alias("epoch"))
    n = written(with_ordinal(n, [By(F.col("ts")), By(F.col("id"))], "place"), "dag")
    mine = F.lag("id").over(Window.partitionBy("u").orderBy("place"))
    first = n.select(F.col("id").alias("commit_id"), F.lit(0).alias("parent_index"), mine.alias("parent_id")).filter("parent_id IS NOT NULL")
    # the latest event of another user comes just before the run of events that a user's event is in: the
    # last change of user up to its place, in its own block of places or in the blocks before it
    before = n.select((F.col("place") + 1).alias("place"), F.col("id").alias("last"), F.col("u").alias("last_u"))
    rows = n.join(before, "place", "left").select("id", "place", F.floor(F.col("place") / _BLOCK).alias("block"), F.when(F.col("u") != F.col("last_u"), F.col("last")).alias("change"))
    rows = rows.withColumn("near", F.last("change", True).over(Window.partitionBy("block").orderBy("place")))
    tops = rows.groupBy("block").agg(F.max_by("near", "place").alias("top"))  # a row a block
    tops = tops.select((F.col("block") + 1).alias("block"), F.last("top", True).over(Window.orderBy("block")).alias("far"))
    second = rows.filter("id % 7 = 0").join(tops, "block", "left").select(F.col("id").alias("commit_id"), F.lit(1).alias("parent_index"), F.coalesce("near", "far").alias("parent_id"))
    parents = written(first.unionByName(second.filter("parent_id IS NOT NULL")), "dag")
    return n, parents


#: Places of the global order that one task sees together.
_BLOCK = 4096


@query(f"""WITH RECURSIVE {_DAG}, w(seed, id, depth) AS (SELECT arg_max(id, (ts, id)), arg_max(id, (ts, id)), 0 FROM n GROUP BY u
UNION ALL SELECT seed, e.parent_id, depth + 1 FROM w JOIN e ON e.commit_id = w.id AND parent_index = 0) SELECT id, CAST(depth AS BIGINT) AS depth, seed FROM w""")
def rev_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-parent history of each user's latest commit."""
    nodes, parents = _commits(spark, sf_dir)
    return G.first_parent_walk(parents, _tips(nodes))


def _tips(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("u").agg(F.max_by("id", "place").alias("id"))


@query(f"""WITH RECURSIVE {_DAG}, f(id, r) AS (SELECT id, 1 FROM n WHERE id NOT IN (SELECT commit_id FROM e)
UNION SELECT e.commit_id, r + 1 FROM f JOIN e ON e.parent_id = f.id) SELECT id, CAST(max(r) AS BIGINT) AS generation FROM f GROUP BY id""")
def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, parents = _commits(spark, sf_dir)
    return G.generations(nodes, parents)


#: Times in days, so that many parents are as late as their children.
_DAYS = 86_400


@query(f"""WITH RECURSIVE {_DAG}, d AS (SELECT id, epoch // {_DAYS} AS own FROM n), f(id, t) AS (SELECT id, own FROM d
UNION SELECT e.commit_id, f.t + 1 FROM f JOIN e ON e.parent_id = f.id JOIN d ON d.id = e.commit_id WHERE f.t + 1 > d.own) SELECT id, CAST(max(t) AS BIGINT) AS corrected FROM f GROUP BY id""")
def corrected_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, parents = _commits(spark, sf_dir)
    return G.corrected_times(nodes.select("id", F.floor(F.col("epoch") / _DAYS).alias("epoch")), parents)


@query(f"WITH {_DAG} SELECT commit_id AS id, count(*) AS n_parents FROM e GROUP BY commit_id HAVING count(*) > 1")
def merge_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parents = _commits(spark, sf_dir)
    return parents.groupBy(F.col("commit_id").alias("id")).agg(F.count(F.lit(1)).alias("n_parents")).filter("n_parents > 1")


@query(f"""WITH RECURSIVE {_DAG}, t AS (SELECT u, arg_max(id, (ts, id)) AS id FROM n GROUP BY u), l(id) AS (SELECT max(id) FROM t UNION SELECT parent_id FROM l JOIN e ON commit_id = id),
r(id) AS (SELECT min(id) FROM t UNION SELECT parent_id FROM r JOIN e ON commit_id = id)
SELECT (SELECT count(*) FROM l WHERE id NOT IN (SELECT id FROM r)) AS ahead, (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM l)) AS behind""")
def ahead_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the users' tips of the greatest and of the least id."""
    nodes, parents = _commits(spark, sf_dir)
    tips = _tips(nodes)
    return G.ahead_behind(parents, tips.agg(F.max("id").alias("id")), tips.agg(F.min("id").alias("id")))


# ---- a tree of regions, nations and customers ----

_TREE = """t AS (SELECT 'root' AS tree_id, r_name AS name, 16384 AS mode, 'r' || r_regionkey AS object_id FROM region
UNION ALL SELECT 'r' || n_regionkey, n_name, 16384, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, c_name, 33188, 'c' || c_custkey FROM customer)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region").selectExpr("'root' AS tree_id", "r_name AS name", "16384 AS mode", "concat('r', r_regionkey) AS object_id")
    n = load(spark, sf_dir, "nation").selectExpr("concat('r', n_regionkey) AS tree_id", "n_name AS name", "16384 AS mode", "concat('n', n_nationkey) AS object_id")
    c = load(spark, sf_dir, "customer").selectExpr("concat('n', c_nationkey) AS tree_id", "c_name AS name", "33188 AS mode", "concat('c', c_custkey) AS object_id")
    return r.unionByName(n).unionByName(c)


_WALK = f"""WITH RECURSIVE {_TREE}, w(path, name, mode, object_id) AS (SELECT name, name, mode, object_id FROM t WHERE tree_id = 'root'
UNION ALL SELECT w.path || '/' || t.name, t.name, t.mode, t.object_id FROM w JOIN t ON w.mode = 16384 AND t.tree_id = w.object_id)"""


@query(f"{_WALK} SELECT path, object_id FROM w WHERE mode <> 16384")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return G.flatten_tree(e, spark.sql("SELECT 'root' AS tree_id")).select("path", "object_id")


@query(f"{_WALK} SELECT path, object_id, mode FROM w")
def tree_walk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return G.flatten_tree(e, spark.sql("SELECT 'root' AS tree_id"), files_only=False).select("path", "object_id", "mode")


@query(f"""{_WALK} SELECT name, object_id FROM w WHERE path = (SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7)""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    row = n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter("n_nationkey = 7").select("r_name", "n_name").first()
    return G.lookup_path(_entries(spark, sf_dir), "root", f"{row[0]}/{row[1]}").select("name", "object_id")


# ---- references: a customer's orders are the history of a reference ----

_SHA = "sha1(CAST(o_orderkey AS VARCHAR))"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.concat(F.lit("refs/heads/c"), "o_custkey").alias("ref_name"), "o_orderdate", "o_orderkey", F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("id"))


@query(f"""SELECT 'refs/heads/c' || o_custkey AS ref_name, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, coalesce(lag({_SHA}) OVER w, repeat('0', 40)) AS original_id, {_SHA} AS target_id
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def reflog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reflog(_history(spark, sf_dir), "ref_name", ["o_orderdate", "o_orderkey"], "id").select("ref_name", "seq", "original_id", "target_id")


@query(f"""SELECT * FROM (SELECT 'refs/heads/c' || o_custkey AS ref_name, {_SHA} AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS BIGINT) AS position FROM orders) WHERE position = 2""")
def stash_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ref_name").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return _history(spark, sf_dir).select("ref_name", "id", (F.row_number().over(w) - 1).cast("long").alias("position")).filter("position = 2")


_REFS = """r AS (SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN sha1(c_name) END AS id, CASE WHEN c_custkey % 4 <> 0 THEN 'c' || (c_custkey - 1) END AS symbolic_target FROM customer)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS name", "CASE WHEN c_custkey % 4 = 0 THEN sha1(c_name) END AS id", "CASE WHEN c_custkey % 4 <> 0 THEN concat('c', c_custkey - 1) END AS symbolic_target")


@query(f"""WITH RECURSIVE {_REFS}, w(name, id, t) AS (SELECT name, id, symbolic_target FROM r UNION ALL SELECT w.name, r.id, r.symbolic_target FROM w JOIN r ON w.id IS NULL AND w.t = r.name)
SELECT name, max(id) AS id FROM w GROUP BY name""")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_references(_refs(spark, sf_dir))


@query("""SELECT 'refs/tags/' || o_orderkey AS name, sha1(CAST(o_orderkey AS VARCHAR)) AS id, CASE WHEN o_orderstatus = 'F' THEN sha1('target' || o_orderkey) ELSE sha1(CAST(o_orderkey AS VARCHAR)) END AS commit_id FROM orders""")
def peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    refs = o.selectExpr("concat('refs/tags/', o_orderkey) AS name", "sha1(CAST(o_orderkey AS STRING)) AS id")
    tags = o.filter("o_orderstatus = 'F'").selectExpr("sha1(CAST(o_orderkey AS STRING)) AS id", "sha1(concat('target', o_orderkey)) AS object_id")
    return G.peel(refs, tags)


@query(f"""WITH i AS (SELECT {_SHA} AS id FROM orders), p AS (SELECT DISTINCT substr(id, 1, 3) AS prefix FROM i)
SELECT prefix, (SELECT CASE WHEN count(DISTINCT id) = 1 THEN min(id) END FROM i WHERE substr(id, 1, 3) = prefix) AS id FROM p""")
def abbrev_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _history(spark, sf_dir).select("id")
    return G.resolve_prefixes(ids, ids.select(F.substring("id", 1, 3).alias("prefix")).distinct(), 3)


@query("""WITH r AS (SELECT 'refs/tags/' || o_orderkey AS name, sha1(CAST(o_orderkey AS VARCHAR)) AS id, CASE WHEN o_orderstatus = 'F' THEN sha1('t' || (o_orderkey % 50)) ELSE sha1(CAST(o_orderkey AS VARCHAR)) END AS commit_id FROM orders)
SELECT DISTINCT sha1('t' || k) AS target, name FROM (SELECT unnest(range(50)) AS k) JOIN r ON sha1('t' || k) IN (id, commit_id)""")
def refs_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    refs = o.selectExpr("concat('refs/tags/', o_orderkey) AS name", "sha1(CAST(o_orderkey AS STRING)) AS id")
    tags = o.filter("o_orderstatus = 'F'").selectExpr("sha1(CAST(o_orderkey AS STRING)) AS id", "sha1(concat('t', o_orderkey % 50)) AS object_id")
    return G.references_to(refs, tags, spark.range(50).selectExpr("sha1(concat('t', id)) AS target"))


# ---- scans over several sources, counts, pack indexes ----


@query("""WITH s AS (SELECT 0 AS rank, 'loose' AS source, sha1(CAST(p_partkey AS VARCHAR)) AS id FROM part WHERE p_size < 25
UNION ALL SELECT 1, 'pack', sha1(CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 10 UNION ALL SELECT 2, 'alternate', sha1(CAST(p_partkey AS VARCHAR)) FROM part)
SELECT id, arg_min(source, rank) AS source FROM s GROUP BY id""")
def object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of object sources; an id comes from the first source that has it."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("id"))
    parts = [p.filter(keep).select("id", F.lit(rank).alias("rank"), F.lit(name).alias("source")) for rank, name, keep in ((0, "loose", "p_size < 25"), (1, "pack", "p_size > 10"), (2, "alternate", "true"))]
    return G.first_source(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["id"], F.col("rank")).select("id", "source")


@query("""SELECT first, CAST(sum(n) OVER (ORDER BY first) AS BIGINT) AS upto FROM (SELECT substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 2) AS first, count(*) AS n FROM part GROUP BY 1)""")
def index_pack_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts by first byte: at most 256 rows reach the window."""
    ids = load(spark, sf_dir, "part").select(F.substring(F.sha1(F.col("p_partkey").cast("string").cast("binary")), 1, 2).alias("first"))
    return ids.groupBy("first").agg(F.count(F.lit(1)).alias("n")).select("first", F.sum("n").over(Window.orderBy("first")).alias("upto"))


@query("""SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS index_position, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS pack_position FROM (SELECT p_partkey, sha1(CAST(p_partkey AS VARCHAR)) AS id FROM part)""")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "part").select("p_partkey", F.sha1(F.col("p_partkey").cast("string").cast("binary")).alias("id"))
    ids = with_ordinal(ids, [By(F.col("id"))], "index_position")
    return with_ordinal(ids, [By(F.col("p_partkey"))], "pack_position").select("id", "index_position", "pack_position")


_STATUS = """h AS (SELECT c_custkey AS path, c_name AS id FROM customer WHERE c_acctbal < 7000), i AS (SELECT c_custkey AS path, CASE WHEN c_nationkey = 6 THEN 'x' ELSE c_name END AS id FROM customer WHERE c_acctbal < 9000),
w AS (SELECT c_custkey AS path, CASE WHEN c_nationkey = 6 THEN 'x' WHEN c_nationkey = 9 THEN 'y' ELSE c_name END AS id FROM customer WHERE c_acctbal > 1000)"""


@query(f"""WITH {_STATUS}, j AS (SELECT coalesce(h.path, i.path, w.path) AS path, h.id AS h, i.id AS i, w.id AS w FROM h FULL JOIN i ON h.path = i.path FULL JOIN w ON coalesce(h.path, i.path) = w.path)
SELECT path, CASE WHEN h IS NULL AND i IS NOT NULL THEN 'A' WHEN h IS NOT NULL AND i IS NULL THEN 'D' WHEN h <> i THEN 'M' END AS index_change,
CASE WHEN i IS NULL AND w IS NOT NULL THEN 'A' WHEN i IS NOT NULL AND w IS NULL THEN 'D' WHEN i <> w THEN 'M' END AS worktree_change FROM j
WHERE (h IS NULL) <> (i IS NULL) OR h <> i OR (i IS NULL) <> (w IS NULL) OR i <> w""")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    h = c.filter("c_acctbal < 7000").selectExpr("c_custkey AS path", "c_name AS id")
    i = c.filter("c_acctbal < 9000").selectExpr("c_custkey AS path", "CASE WHEN c_nationkey = 6 THEN 'x' ELSE c_name END AS id")
    w = c.filter("c_acctbal > 1000").selectExpr("c_custkey AS path", "CASE WHEN c_nationkey = 6 THEN 'x' WHEN c_nationkey = 9 THEN 'y' ELSE c_name END AS id")
    return G.status(h, i, w)


@query("""WITH c AS (SELECT 'user' AS grp, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 's' || event_id % 4 END AS sub, event_type AS key, CAST(value AS VARCHAR) AS value, event_id AS n FROM events)
SELECT grp, sub, key, max(n) AS line FROM c GROUP BY ALL""")
def config_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered configuration: the last setting of a key holds; a null subgroup is a key of its own."""
    c = load(spark, sf_dir, "events").select(F.lit("user").alias("grp"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), F.col("event_id") % 4)).alias("sub"), F.col("event_type").alias("key"), F.col("event_id").alias("n"))
    return c.groupBy("grp", "sub", "key").agg(F.max("n").alias("line"))


@query(f"""WITH RECURSIVE {_DAG}, r(id) AS (SELECT arg_max(id, (ts, id)) FROM n GROUP BY u UNION SELECT parent_id FROM r JOIN e ON commit_id = id),
c AS (SELECT n.id, n.epoch, k.n_parents FROM n JOIN (SELECT commit_id, count(*) AS n_parents FROM e GROUP BY 1) k ON k.commit_id = n.id WHERE n.id IN (SELECT id FROM r)),
top AS (SELECT * FROM c WHERE n_parents >= 1 ORDER BY epoch DESC, id DESC LIMIT 32)
SELECT id, CAST(row_number() OVER (ORDER BY epoch, id) - 1 AS BIGINT) AS rn FROM top""")
def rev_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 latest commits with parents reached from the users' tips, oldest first."""
    nodes, parents = _commits(spark, sf_dir)
    return G.revision_list(nodes.select("id", "epoch"), parents, _tips(nodes).select("id"), min_parents=1, max_count=32, reverse=True).select("id", "rn")


_BLOB = "sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text))"


@query(f"""SELECT id, 'corrupt' AS problem FROM (SELECT CASE WHEN source = 'src3' THEN sha1(CAST(doc_id AS VARCHAR)) ELSE {_BLOB} END AS id, {_BLOB} AS real FROM documents) WHERE id <> real
UNION ALL SELECT DISTINCT sha1('gone' || doc_id), 'missing' FROM documents WHERE lang = 'de'""")
def fsck(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.binary import object_id

    d = load(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    id_ = F.when(F.col("source") == "src3", F.sha1(F.col("doc_id").cast("string").cast("binary"))).otherwise(object_id(F.lit("blob"), body))
    objects = d.select(id_.alias("id"), F.lit("blob").alias("type"), body.alias("content"))
    edges = d.filter("lang = 'de'").select(F.lit("x").alias("from_id"), F.sha1(F.concat(F.lit("gone"), "doc_id").cast("binary")).alias("to_id"))
    return G.check_objects(objects, edges)
