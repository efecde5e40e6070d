"""Mixing sources to target weights without a sort.

Every document gets a 52-bit hash of its id.  Tokens are summed by source and
hash bucket; nested budget thresholds are found in those histograms, and only
the bucket in which a source's budget ends is refined, level by level, until
its boundary is one hash value.  A filter on the hash then selects the mix.

Defined results: a null text has size 0; null sources are one source, last in
order; rows of one ``doc_id`` share a hash and are taken together; a null
``doc_id`` is hashed by its text; an empty table gives an empty result; other
columns pass through untouched, whatever their names.  Targets are found in one
task, which sees one short row a source (three numbers and a name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Bits of the hash, taken this many at a time: 4 levels of 8192 buckets.
HASH_BITS, LEVEL_BITS = 52, 13


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    A source's target is min(cap * size, rate * weight).  Sorted by the rate at
    which they reach their caps, the capped sources are a prefix, so the rate
    is found with running sums over the source table (one row a source).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("rank"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", w.alias("w"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = ranked.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
        F.sum("w").over(everything).alias("w_all"),
        (F.sum("source_size").over(everything) * share).alias("budget"),
    )
    # the rate if exactly the sources before this one are capped; the first that stays below its cap holds
    rate = (F.col("budget") - F.col("most_before")) / (F.col("w_all") - F.col("w_before"))
    run = run.select("*", F.when(rate * F.col("w") <= F.col("most"), rate).alias("free"), F.col("most_before").alias("mb"))
    chosen = F.min(F.when(F.col("free").isNotNull(), F.struct("mb", "free"))).over(everything)
    return run.select("source", "source_size", F.least(F.col("most"), F.coalesce(chosen["free"] * F.col("w"), F.col("most"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, hash) and (source, want) -> source, edge, below.

    ``edge`` is the hash value at which the running size of the source passes
    ``want``; ``below`` is the size of the hashes under it.
    """
    state = goals.select("source", "want", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # only rows in the boundary bucket of their source so far
        rows = sized.join(state, sized["source"].eqNullSafe(state["source"]) & (F.shiftright(sized["hash"], shift + LEVEL_BITS) == state["prefix"]))
        hist = rows.groupBy(sized["source"].alias("source"), F.shiftright(sized["hash"], shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("want").alias("want"), F.first("below").alias("below")
        )
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.select("source", "want", "bucket", "size", (F.col("below") + run).alias("to"))
        cut = (
            hist.filter(F.col("to") > F.col("want"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "to", "size", "want")).alias("b"))
            .select("source", F.col("b.want").alias("want"), F.col("b.bucket").alias("prefix"), (F.col("b.to") - F.col("b.size")).alias("below"))
        )
        state = materialize(cut, "mix-level", thin=True)
    return state.select("source", F.col("prefix").alias("edge"), "below")


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size, hash) -> one row a source: source_size, target, whole, edge, edge_in.

    A target of r times the source's size takes every document floor(r) times
    (``whole``) and those under the hash threshold ``edge`` of the rest once
    more.  The documents on the threshold itself are taken (``edge_in``) if
    that ends nearer to the target.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0)
    goal = materialize(goal.select("*", whole.cast("long").alias("whole")), "mix-goal", thin=True)
    want = goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("want"))
    edges = thresholds(sized, want)
    at_edge = (
        sized.join(edges, sized["source"].eqNullSafe(edges["source"]) & (sized["hash"] == edges["edge"]))
        .groupBy(edges["source"].alias("source"), "edge", "below")
        .agg(F.sum("size").alias("edge_size"))
    )
    g, e = goal.alias("g"), at_edge.alias("e")
    taken = F.col("below") + F.col("whole") * F.col("source_size") - F.col("target")
    edge_in = F.abs(taken + F.col("edge_size")) < F.abs(taken)
    out = g.join(e, F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    return materialize(out.select("g.source", "source_size", "target", "whole", "edge", edge_in.alias("edge_in")), "mix-plan", thin=True)


def copies_of(hash_: Column, cap: float = CAP) -> Column:
    """How often a document is taken, from its hash and its source's row of the plan."""
    more = F.coalesce((hash_ < F.col("edge")) | ((hash_ == F.col("edge")) & F.col("edge_in")), F.lit(True))
    return F.least(F.col("whole") + more.cast("long"), F.lit(int(cap)))


def sized_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, taken, copies."""
    sized = materialize(sized_of(docs), "mix-sized")
    s, p = sized.alias("s"), plan(sized, weights, share, cap).alias("p")
    copies = copies_of(F.col("s.hash"), cap)
    return s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "s.doc_id", "s.source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the plan is one row a source, and texts stay in place."""
    rates = plan(materialize(sized_of(docs), "mix-sized"), weights, share, cap)
    d, p = docs.alias("d"), rates.alias("p")
    copies = copies_of(hash_of(F.col("d.doc_id"), F.col("d.text")), cap)
    times, each = free_name(docs, "copies"), free_name(docs, "copy")
    rows = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", copies.alias(times)).filter(F.col(times) > 0)
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(each, times)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _md5_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"


ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         {_md5_sql("coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))")} AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS most FROM src),
fill(step, rate) AS (
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM ranked)
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM ranked) - coalesce(sum(most) FILTER (WHERE rate * w > most), 0.0)) / sum(w) FILTER (WHERE rate * w <= most) FROM ranked)
  FROM fill WHERE step < 200),
goal AS (
  SELECT source, source_size, least(most, (SELECT max(rate) FROM fill) * w) AS target FROM ranked),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM goal),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS here
  FROM sized s JOIN whole g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM (
  SELECT *, least(2, whole + CASE
    WHEN upto <= target - whole * source_size THEN 1
    WHEN upto - here <= target - whole * source_size AND abs(upto + whole * source_size - target) < abs(upto - here + whole * source_size - target) THEN 1
    ELSE 0 END) AS copies FROM run)
"""
