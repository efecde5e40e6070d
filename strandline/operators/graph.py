"""Graph operators over edge tables: history walks, generations, tree flattening and reference resolution.

Edges and nodes are plain tables, and no walk has a limit.  Chains (first
parents, symbolic references) are followed by pointer doubling, in as many
rounds as the length of the longest has binary digits.  Reachability alternates
between closing whole chains and stepping to the other parents; longest paths
run over a graph in which chains are single edges.  Trees go level by level.
Each round starts from written tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import discard, written


def _chain(parents: DataFrame) -> DataFrame:
    """(id, to): each commit and its first parent."""
    return parents.filter("parent_index = 0").groupBy(F.col("commit_id").alias("id")).agg(F.min("parent_id").alias("to"))


def _jumps(chain: DataFrame, *carried: tuple[str, Column]):
    """Written tables (id, to, ...): the ends of 1, 2, 4, ... steps along a chain, as long as there are any.

    ``carried`` columns of two joined jumps are told by expressions over ``x`` (the first) and ``y`` (the second).
    """
    table, steps, nodes = written(chain, "jump"), 1, None
    while not table.isEmpty():
        yield steps, table
        nodes = table.count() if nodes is None else nodes
        if steps > 2 * nodes:
            raise ValueError("the chain of first parents has a cycle")
        table = written(table.alias("x").join(table.alias("y"), F.col("x.to") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.to").alias("to"), *[e.alias(n) for n, e in carried]), "jump")
        steps *= 2


def first_parent_walk(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(commit_id, parent_index, parent_id), (id) -> id, depth, seed: each seed and its whole chain of first parents."""
    parts = [written(seeds.select("id", F.lit(0).cast("long").alias("depth"), F.col("id").alias("seed")).distinct(), "walk")]
    for steps, jump in _jumps(_chain(parents)):
        # what is known lies less than ``steps`` deep; the same again, that much deeper
        known = reduce(DataFrame.unionByName, parts)
        further = known.alias("w").join(jump.alias("j"), F.col("w.id") == F.col("j.id"))
        parts.append(written(further.select(F.col("j.to").alias("id"), (F.col("w.depth") + steps).alias("depth"), "w.seed"), "walk"))
        if parts[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def ancestors(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(commit_id, parent_index, parent_id), (id) -> seed, id: everything each seed reaches, itself included."""
    return _reached(parents, seeds.select(F.col("id").alias("seed"), "id"))


def reachable(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(commit_id, parent_index, parent_id), (id) -> id: everything that any of the seeds reaches, themselves included."""
    return _reached(parents, seeds.select(F.lit(0).alias("seed"), "id")).select("id")


def _reached(parents: DataFrame, start: DataFrame) -> DataFrame:
    jumps = [jump for _, jump in _jumps(_chain(parents))]
    others = written(parents.filter("parent_index > 0").select("commit_id", "parent_id").distinct(), "others")
    frontier, known = written(start.distinct(), "reach"), []
    while not frontier.isEmpty():
        # all of the frontier's chains: after the jumps of 1, 2, 4, ... steps no first parent is missing
        closed = frontier
        for i, jump in enumerate(jumps):
            more = closed.alias("c").join(jump.alias("j"), F.col("c.id") == F.col("j.id")).select("c.seed", F.col("j.to").alias("id"))
            closed = closed.unionByName(more).distinct()
            if i % 2:  # two jumps a table
                closed = written(closed, "reach")
        new = written(_without(closed, known), "reach")
        known.append(new)
        step = new.join(others, new["id"] == others["commit_id"]).select("seed", F.col("parent_id").alias("id")).distinct()
        frontier = written(_without(step, known), "reach")
    discard(*jumps)
    return reduce(DataFrame.unionByName, known) if known else start.distinct()


def _without(rows: DataFrame, known: list[DataFrame]) -> DataFrame:
    return rows.join(reduce(DataFrame.unionByName, known), ["seed", "id"], "left_anti") if known else rows


def ahead_behind(parents: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many commits only the left and only the right seeds reach."""
    start = left.select(F.lit("l").alias("seed"), "id").unionByName(right.select(F.lit("r").alias("seed"), "id"))
    sides = _reached(parents, start).groupBy("id").agg(F.bool_or(F.col("seed") == "l").alias("l"), F.bool_or(F.col("seed") == "r").alias("r"))
    return sides.agg(F.count_if(~F.col("r")).alias("ahead"), F.count_if(~F.col("l")).alias("behind"))


def longest(nodes: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """(id, own), (commit_id, parent_id) -> id, name: own value, or one more than the greatest value of the parents where that is greater.

    Parents that are no nodes do not count.  Runs of nodes with one parent are
    contracted to one edge each, with the number of steps and the greatest own
    value counted on to its end; only the nodes with none or several parents
    are then improved round by round, from those that changed last.
    """
    node = written(nodes.select("id", F.col("own").cast("long").alias("own")).groupBy("id").agg(F.max("own").alias("own")), "long")
    edges = parents.select("commit_id", "parent_id").distinct().join(node.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
    edges = written(edges.join(node.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("commit_id", "parent_id"), "long")
    single = edges.groupBy(F.col("commit_id").alias("id")).agg(F.min("parent_id").alias("to"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("id", "to")
    chain = single.join(node, "id").select("id", "to", F.lit(1).cast("long").alias("steps"), F.col("own").alias("best"))
    # a run ends at the first node that is not single; until then its length doubles
    runs, limit = written(chain, "run"), 2 * node.count() + 2
    while True:
        step = runs.alias("x").join(runs.alias("y"), F.col("x.to") == F.col("y.id"), "left")
        step = step.select("x.id", F.coalesce("y.to", "x.to").alias("to"), (F.col("x.steps") + F.coalesce("y.steps", F.lit(0))).alias("steps"), F.greatest("x.best", F.col("y.best") + F.col("x.steps")).alias("best"), F.col("y.id").isNotNull().alias("moved"))
        step = written(step, "run")
        moved, most = step.agg(F.count_if("moved"), F.max("steps")).first()
        discard(runs)
        runs = step.drop("moved")
        if not moved:
            break
        if most > limit:
            raise ValueError("the graph has a cycle")
    # edges of the contracted graph: from a node that is not single to the ends of its parents' runs
    knots = node.join(single.select("id"), "id", "left_anti")
    several = edges.join(knots.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
    run = runs.select(F.col("id").alias("parent_id"), "to", "steps", "best")
    hops = several.join(run, "parent_id", "left").select("commit_id", F.coalesce("to", "parent_id").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), (F.col("best") + 1).alias("best"))
    hops = written(hops, "hops")
    least = hops.groupBy(F.col("commit_id").alias("id")).agg(F.max("best").alias("best"))
    value = written(knots.join(least, "id", "left").select("id", F.greatest("own", "best").alias("value")), "value")
    hops = written(hops.groupBy("commit_id", "to").agg(F.max("steps").alias("steps")), "hops")
    changed, rounds = value, 0
    while not changed.isEmpty():
        better = changed.join(hops, F.col("id") == F.col("to")).groupBy(F.col("commit_id").alias("id")).agg(F.max(F.col("value") + F.col("steps")).alias("found"))
        changed = written(better.join(value, "id").filter("found > value").select("id", F.col("found").alias("value")), "value")
        value = written(value.join(changed.withColumnRenamed("value", "now"), "id", "left").select("id", F.coalesce("now", "value").alias("value")), "value")
        rounds += 1
        if rounds > limit:
            raise ValueError("the graph has a cycle")
    end = value.select(F.col("id").alias("to"), "value")
    along = runs.join(end, "to").select("id", F.greatest("best", F.col("value") + F.col("steps")).alias(name))
    return value.select("id", F.col("value").alias(name)).unionByName(along)


def generations(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id), (commit_id, parent_id) -> id, generation: one more than the greatest generation of the parents, 1 without any."""
    return longest(nodes.select("id", F.lit(1).alias("own")), parents, "generation")


def corrected_times(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, epoch) -> id, corrected: own time, but later than every parent's corrected time."""
    return longest(nodes.select("id", F.col("epoch").alias("own")), parents, "corrected")


def flatten_tree(entries: DataFrame, roots: DataFrame, files_only: bool = True) -> DataFrame:
    """(tree_id, name, mode, object_id), (tree_id) -> root, path, name, mode, object_id of all entries below the roots."""
    e = entries.select("tree_id", "name", "mode", "object_id")
    columns = ("root", "path", "name", "mode", "object_id")
    level = roots.select(F.col("tree_id").alias("root"), "tree_id").distinct().join(e, "tree_id").select("root", F.col("name").alias("path"), "name", "mode", "object_id")
    levels, most = [written(level, "tree")], None
    while True:
        folders = levels[-1].filter("mode = 16384").select("root", F.col("path").alias("above"), F.col("object_id").alias("tree_id"))
        if folders.isEmpty():
            break
        most = entries.select("tree_id").distinct().count() if most is None else most
        if len(levels) > most:
            raise ValueError("a tree contains itself")
        levels.append(written(folders.join(e, "tree_id").withColumn("path", F.concat_ws("/", "above", "name")).select(*columns), "tree"))
    out = reduce(DataFrame.unionByName, levels)
    return out.filter("mode != 16384") if files_only else out


def lookup_path(entries: DataFrame, root: str, path: str) -> DataFrame:
    """The entry at a path, component by component; an empty component finds nothing."""
    parts = path.split("/")
    if not all(parts):
        return entries.limit(0)
    at = entries.filter((F.col("tree_id") == root) & (F.col("name") == parts[0]))
    for name in parts[1:]:
        below = entries.filter(F.col("name") == name).alias("e")
        at = at.select(F.col("object_id").alias("__t")).join(below, F.col("__t") == F.col("e.tree_id")).select("e.*")
    return at


def resolve_references(refs: DataFrame) -> DataFrame:
    """(name, id, symbolic_target) -> name, id: symbolic references followed to an id; dangling and cyclic ones are null.

    Every round each open reference takes over what its target knows, so the
    rounds follow the binary digits of the longest chain.
    """
    own = refs.groupBy("name").agg(F.max("id").alias("id"), F.max("symbolic_target").alias("target"))
    table = written(own.select("name", "id", F.when(F.col("id").isNull(), F.col("target")).alias("target")), "refs")
    rounds = max(1, table.count()).bit_length() + 1
    for _ in range(rounds):  # after that many, what is open is a cycle
        if table.filter("target IS NOT NULL").isEmpty():
            break
        t = table.select(F.col("name").alias("t_name"), F.col("id").alias("t_id"), F.col("target").alias("t_target"))
        step = table.join(t, table["target"] == F.col("t_name"), "left")
        table = written(step.select("name", F.coalesce("id", "t_id").alias("id"), F.col("t_target").alias("target")), "refs")
    return table.select("name", "id")


def peel(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, id), (id, object_id) -> name, id, commit_id: through an annotated tag, one level."""
    t = tags.select(F.col("id").alias("__tag"), F.col("object_id"))
    return refs.join(t, F.col("id") == F.col("__tag"), "left").select("name", "id", F.coalesce("object_id", "id").alias("commit_id"))


def resolve_prefixes(ids: DataFrame, prefixes: DataFrame, digits: int) -> DataFrame:
    """(id), (prefix) of ``digits`` hexadecimal digits -> prefix, id: the only id it begins, else null."""
    by = ids.select(F.substring("id", 1, digits).alias("prefix"), "id").groupBy("prefix").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return prefixes.join(by, "prefix", "left").select("prefix", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def references_to(refs: DataFrame, tags: DataFrame, ids: DataFrame) -> DataFrame:
    """(target, name): references that point at an id, directly or through a tag; two equi-joins."""
    p = peel(refs, tags)
    direct = ids.join(p, ids["target"] == p["id"]).select("target", "name")
    through = ids.join(p, ids["target"] == p["commit_id"]).select("target", "name")
    return direct.union(through).distinct()


def first_source(rows: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """One row a key, from the source of least rank; a partial aggregate, not a sort."""
    names = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*names), rank).alias("r"))
    return picked.select(*key, *[F.col("r")[c].alias(c) for c in names])


def reflog(history: DataFrame, ref: str, order: list[str], id_: str) -> DataFrame:
    """Each change of a reference with the id before it; zeros before the first."""
    w = Window.partitionBy(ref).orderBy(*order)
    zero = F.rpad(F.lit("0"), 40, "0")
    return history.select("*", F.coalesce(F.lag(id_).over(w), zero).alias("original_id"), F.col(id_).alias("target_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"))


def status(head: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, id) thrice -> path, index_change, worktree_change for what differs: A, M or D."""
    joined = head.withColumnRenamed("id", "h").join(index.withColumnRenamed("id", "i"), "path", "full").join(worktree.withColumnRenamed("id", "w"), "path", "full")

    def change(a: str, b: str) -> Column:
        return F.when(F.col(a).isNull() & F.col(b).isNotNull(), "A").when(F.col(a).isNotNull() & F.col(b).isNull(), "D").when(F.col(a) != F.col(b), "M")

    out = joined.select("path", change("h", "i").alias("index_change"), change("i", "w").alias("worktree_change"))
    return out.filter("index_change IS NOT NULL OR worktree_change IS NOT NULL")


def revision_list(commits: DataFrame, parents: DataFrame, seeds: DataFrame, first_parent: bool = False, min_parents: int | None = None, max_parents: int | None = None,
                  order: str = "date", reverse: bool = False, max_count: int | None = None) -> DataFrame:
    """(id, epoch[, author_epoch, generation]) reached from the seeds, filtered, ordered and cut, with their position ``rn``.

    ``order`` is ``date`` (committed), ``author-date`` or ``topo`` (by falling generation).  The count is cut before the
    order is reversed, as a history is.
    """
    reached = reachable(parents.filter("parent_index = 0") if first_parent else parents, seeds)
    counts = parents.groupBy(F.col("commit_id").alias("id")).agg(F.count(F.lit(1)).alias("n_parents"))
    rows = commits.join(reached, "id", "left_semi").join(counts, "id", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))
    if min_parents is not None:
        rows = rows.filter(F.col("n_parents") >= min_parents)
    if max_parents is not None:
        rows = rows.filter(F.col("n_parents") <= max_parents)
    keys = {"date": ["epoch"], "author-date": ["author_epoch"], "topo": ["generation", "epoch"]}[order]
    sort = [*[F.desc(k) for k in keys], F.desc("id")]
    if max_count is not None:
        rows = rows.orderBy(*sort).limit(max_count)
    from .sequence import By, with_ordinal

    return with_ordinal(rows, [By(F.col(k), not reverse) for k in [*keys, "id"]], "rn")


def check_objects(objects: DataFrame, edges: DataFrame, sha256: bool = False) -> DataFrame:
    """(id, type, content), (from_id, to_id) -> id, problem: contents that do not hash to their id, and targets that are missing."""
    from ..functions.binary import object_id

    wrong = objects.filter(object_id(F.col("type"), F.col("content"), sha256) != F.col("id")).select("id", F.lit("corrupt").alias("problem"))
    missing = edges.select(F.col("to_id").alias("id")).distinct().join(objects.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    return wrong.unionByName(missing)
