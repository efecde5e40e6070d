"""Ordered sequences over DataFrames.

Spark's rows have no order; a ``Sequence`` is a DataFrame with a list of order
expressions that ends in a unique key.  Operators that need positions compute
them on demand; the others ignore the order, so Catalyst sees plain filters,
projections, joins and aggregates.

Custom equality is expressed by a key function: rows are equal if their keys
are, and the first row in sequence order stands for its equals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = "__ordinal"
#: Inputs estimated larger than this get their positions from ranges instead of one sorted task.
ONE_TASK_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class By:
    """One order expression; nulls are least either way."""

    key: Column
    descending: bool = False

    def column(self) -> Column:
        return self.key.desc_nulls_last() if self.descending else self.key.asc_nulls_first()


def sort_columns(order: list[By]) -> list[Column]:
    return [b.column() for b in order]


def with_ordinal(df: DataFrame, order: list[By], name: str = ORDINAL, one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """Add the 0-based position of each row.

    Small inputs are numbered by one window.  Larger ones are cut into ranges
    of the whole order at rows from a sample; rows are numbered within their
    range and shifted by the sizes of the ranges before it, so no task sees
    more than a range, also where one value of the first key is hot, and only
    one row a range reaches the driver beside the sample.
    """
    spark = df.sparkSession
    if estimated_bytes(df) <= one_task_bytes:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*sort_columns(order))) - 1).cast("long"))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, 100.0 * ranges / max(1, df.count()))
    keys = df.select(*[b.key.alias(f"k{i}") for i, b in enumerate(order)])
    points = keys.sample(share, 7).orderBy(*[By(F.col(f"k{i}"), b.descending).column() for i, b in enumerate(order)]).collect()
    cuts = [points[i * len(points) // ranges] for i in range(1, ranges)] if points else []
    made = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, keys.schema, strict=True)]) for c in cuts])
    bucket = F.size(F.filter(made, lambda c: _reached(c, order))) if cuts else F.lit(0)
    tagged = df.withColumn("__range", bucket)
    sizes = sorted((r["__range"], r["n"]) for r in tagged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, {}
    for b, n in sizes:
        offsets[b] = before
        before += n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("__range")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*sort_columns(order))) - 1
    return tagged.withColumn(name, (start + place).cast("long")).drop("__range")


def _reached(cut: Column, order: list[By]) -> Column:
    """Whether a row does not come before a cut, a struct of the order's keys."""
    out = F.lit(True)
    for i, b in reversed(list(enumerate(order))):
        own, other = b.key, cut[f"k{i}"]
        first, last = (own, other) if b.descending else (other, own)  # nulls are least: first when rising, last when falling
        after = F.coalesce(last > first, first.isNull() & last.isNotNull())
        out = after | (own.eqNullSafe(other) & out)
    return out


class Sequence:
    """A DataFrame and its order; every method returns a new Sequence unless it says otherwise.

    ``dense`` says that the rows have their positions, from 0 on without a gap, in the column ORDINAL.
    """

    def __init__(self, df: DataFrame, order: list[By | str], dense: bool = False):
        self.df = df
        self.order = [By(F.col(o)) if isinstance(o, str) else o for o in order]
        self.dense = dense

    @classmethod
    def of(cls, spark, rows: list, schema: str) -> Sequence:
        """A sequence of literal rows in the order given."""
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ORDINAL} long, {schema}")
        return cls(df, [ORDINAL], True)

    def _numbered(self) -> DataFrame:
        """The rows with their positions; an ordinal of an order or of rows that were before is no position."""
        if self.dense:
            return self.df
        fresh = with_ordinal(self.df, self.order, "__position")
        return fresh.drop(ORDINAL).withColumnRenamed("__position", ORDINAL)

    def indexed(self) -> Sequence:
        """With the position as column; later operators keep it as their order."""
        return Sequence(self._numbered(), [ORDINAL], True)

    # ---- projection and restriction ----

    def where(self, predicate: Column | Callable[[Column], Column]) -> Sequence:
        """Rows for which the predicate is true; a function gets the row's position."""
        if callable(predicate) and not isinstance(predicate, Column):
            return Sequence(self._numbered().filter(F.coalesce(predicate(F.col(ORDINAL)), F.lit(False))), [ORDINAL])
        return Sequence(self.df.filter(predicate), self.order)

    def select(self, *columns: Column | Callable[[Column], Column]) -> Sequence:
        """Project; a function gets the row's position.  The order columns are kept beside."""
        if any(callable(c) and not isinstance(c, Column) for c in columns):
            df = self._numbered()
            return Sequence(df.select(ORDINAL, *[c if isinstance(c, Column) else c(F.col(ORDINAL)) for c in columns]), [ORDINAL], True)
        return Sequence(self.df.select(*columns), self.order)

    def cast(self, **types: str) -> Sequence:
        """Cast columns; a value that does not fit raises."""
        return Sequence(self.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}), self.order)

    def of_type(self, column: str, kind: str) -> Sequence:
        return self.where(F.col(column) == kind)

    def select_many(self, array: Column | Callable[[Column], Column], alias: str = "element", position: str | None = None) -> Sequence:
        """One row for each element of an array; ``position`` names the element's place."""
        df = self._numbered()
        value = array(F.col(ORDINAL)) if callable(array) and not isinstance(array, Column) else array
        df = df.select("*", F.posexplode(value).alias(position or "__inner", alias))
        return Sequence(df, [ORDINAL, position or "__inner"])

    def select_many_from(self, other: DataFrame, condition: Column) -> DataFrame:
        """Each row with all rows of another table that satisfy a condition on both (a theta join; a DataFrame)."""
        return self.df.join(other, condition)

    # ---- slices ----

    def take(self, n: int) -> Sequence:
        return Sequence(self.df.orderBy(*sort_columns(self.order)).limit(n), self.order)

    def skip(self, n: int) -> Sequence:
        return Sequence(self._numbered().filter(F.col(ORDINAL) >= n), [ORDINAL])

    def _leading(self, predicate) -> tuple[DataFrame, Column]:
        """Numbered rows and the position of the first that fails the predicate; null if none does."""
        df = self._numbered()
        test = predicate(F.col(ORDINAL)) if callable(predicate) and not isinstance(predicate, Column) else predicate
        stop = df.filter(~F.coalesce(test, F.lit(False))).agg(F.min(ORDINAL).alias("__stop"))  # one row
        return df.crossJoin(F.broadcast(stop)), F.col("__stop")

    def take_while(self, predicate) -> Sequence:
        df, stop = self._leading(predicate)
        return Sequence(df.filter(stop.isNull() | (F.col(ORDINAL) < stop)).drop("__stop"), [ORDINAL], True)

    def skip_while(self, predicate) -> Sequence:
        df, stop = self._leading(predicate)
        return Sequence(df.filter(F.col(ORDINAL) >= stop).drop("__stop"), [ORDINAL])

    # ---- order ----

    def order_by(self, key: Column, descending: bool = False) -> Sequence:
        """Stable sort: equal keys keep their order; nulls are least."""
        return Sequence(self.df, [By(key, descending), *self.order])

    def then_by(self, key: Column, descending: bool = False, after: int = 1) -> Sequence:
        """A further key behind the first ``after`` ones."""
        return Sequence(self.df, [*self.order[:after], By(key, descending), *self.order[after:]])

    def reverse(self) -> Sequence:
        return Sequence(self._numbered(), [By(F.col(ORDINAL), True)])

    # ---- sets ----

    def concat(self, other: Sequence) -> Sequence:
        a = self._numbered().withColumn("__branch", F.lit(0))
        b = other._numbered().withColumn("__branch", F.lit(1))
        return Sequence(a.unionByName(b, allowMissingColumns=True), ["__branch", ORDINAL])

    def distinct(self, *keys: Column) -> Sequence:
        """The first row of each key, in order; without keys, distinct rows."""
        if not keys:
            return Sequence(self.df.distinct(), self.order)
        return Sequence(first_per_key(self._numbered(), list(keys), [F.col(ORDINAL)]), [ORDINAL])

    def union(self, other: Sequence, *keys: Column) -> Sequence:
        both = self.concat(other)
        return Sequence(first_per_key(both.df, list(keys), [F.col("__branch"), F.col(ORDINAL)]), ["__branch", ORDINAL])

    def _membership(self, other: Sequence, keys: tuple, kind: str) -> Sequence:
        own = first_per_key(self._numbered(), list(keys), [F.col(ORDINAL)]).withColumns({f"__k{i}": k for i, k in enumerate(keys)})
        there = other.df.select(*[k.alias(f"__o{i}") for i, k in enumerate(keys)]).distinct()
        on = [own[f"__k{i}"].eqNullSafe(there[f"__o{i}"]) for i in range(len(keys))]
        return Sequence(own.join(there, on, kind).drop(*[f"__k{i}" for i in range(len(keys))]), [ORDINAL])

    def except_(self, other: Sequence, *keys: Column) -> Sequence:
        return self._membership(other, keys, "left_anti")

    def intersect(self, other: Sequence, *keys: Column) -> Sequence:
        return self._membership(other, keys, "left_semi")

    # ---- groups and joins (DataFrames) ----

    def group_by(self, key: Column, element: Column | None = None, result: list[Column] | None = None, equal: Callable[[Column], Column] | None = None, name: str = "key") -> DataFrame:
        """Groups in the order of their first rows.

        Without ``result`` a group has its ``elements`` in order (the whole row
        or ``element``).  ``equal`` maps keys to what is compared; the first
        key met then names the group.
        """
        norm = equal(key) if equal else key
        if result and not equal:
            return self.df.groupBy(norm.alias(name)).agg(*result)
        df = self._numbered().withColumn("__element", element if element is not None else F.struct(*[c for c in self.df.columns if not c.startswith("__")]))
        grouped = df.groupBy(norm.alias("__norm"))
        first = F.min_by(key, ORDINAL).alias(name)
        if result:
            return grouped.agg(first, *result).drop("__norm")
        items = F.transform(F.array_sort(F.collect_list(F.struct(ORDINAL, "__element"))), lambda x: x["__element"])
        return grouped.agg(first, items.alias("elements")).drop("__norm")

    def join(self, inner: DataFrame, outer_key: Column, inner_key: Column, equal: Callable[[Column], Column] | None = None) -> DataFrame:
        """Inner equi-join; null keys match nothing."""
        a, b = (equal(outer_key), equal(inner_key)) if equal else (outer_key, inner_key)
        return self.df.join(inner, a == b)

    def group_join(self, inner: Sequence, outer_key: Column, inner_key: Column, element: Column, equal: Callable[[Column], Column] | None = None) -> DataFrame:
        """Each row with the ordered list of its matches, empty where there are none."""
        norm = equal or (lambda c: c)
        side = inner._numbered().select(norm(inner_key).alias("__ik"), F.struct(ORDINAL, element.alias("e")).alias("__e"))
        lists = side.filter(F.col("__ik").isNotNull()).groupBy("__ik").agg(F.transform(F.array_sort(F.collect_list("__e")), lambda x: x["e"]).alias("matches"))
        joined = self.df.join(lists, norm(outer_key) == F.col("__ik"), "left").drop("__ik")
        kind = joined.schema["matches"].dataType
        return joined.withColumn("matches", F.coalesce("matches", F.array().cast(kind)))

    def zip(self, other: Sequence) -> DataFrame:
        """Pairs of rows of equal position, as long as the shorter sequence."""
        return self._numbered().join(other._numbered(), ORDINAL)

    def default_if_empty(self, **values) -> Sequence:
        """The rows, or one row of the given values (nulls otherwise) if there are none."""
        one = self.df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema.fields])
        empty = self.df.limit(1).agg((F.count(F.lit(1)) == 0).alias("__empty"))
        fill = one.crossJoin(F.broadcast(empty)).filter("__empty").drop("__empty")
        return Sequence(self.df.unionByName(fill), self.order)

    # ---- terminals (values) ----

    def to_df(self) -> DataFrame:
        return self.df.drop(*[c for c in self.df.columns if c.startswith("__")])

    def to_list(self) -> list:
        return Sequence(self.df.orderBy(*sort_columns(self.order)), self.order).to_df().collect()

    def count(self, predicate: Column | None = None) -> int:
        return (self.df.filter(predicate) if predicate is not None else self.df).count()

    def any(self, predicate: Column | None = None) -> bool:
        return not (self.df.filter(predicate) if predicate is not None else self.df).isEmpty()

    def all(self, predicate: Column) -> bool:
        return self.df.filter(~F.coalesce(predicate, F.lit(False))).isEmpty()

    def first_or_none(self, predicate: Column | None = None):
        rows = (self.where(predicate) if predicate is not None else self).take(1).to_list()
        return rows[0] if rows else None

    def first(self, predicate: Column | None = None):
        row = self.first_or_none(predicate)
        if row is None:
            raise LookupError("the sequence has no such row")
        return row

    def last(self, predicate: Column | None = None):
        return (self.where(predicate) if predicate is not None else self).reverse().first()

    def single(self, predicate: Column | None = None):
        rows = (self.where(predicate) if predicate is not None else self).take(2).to_list()
        if len(rows) != 1:
            raise LookupError("the sequence does not have exactly one such row")
        return rows[0]

    def element_at(self, index: int):
        return Sequence(self._numbered().filter(F.col(ORDINAL) == index), [ORDINAL]).first()

    def contains(self, value: Column, item) -> bool:
        return self.any(value.eqNullSafe(F.lit(item)))

    def fold(self, value: Column):
        """A built-in aggregate of the rows."""
        return self.df.agg(value).first()[0]

    def sequence_equal(self, other: Sequence) -> bool:
        """Whether both have equal rows in equal order."""
        a = self._numbered()
        b = other._numbered()
        names = [c for c in self.df.columns if not c.startswith("__")]
        left = a.select(ORDINAL, F.struct(*names).alias("x"))
        right = b.select(F.col(ORDINAL).alias("__other"), F.struct(*names).alias("y"))
        return left.join(right, F.col(ORDINAL) == F.col("__other"), "full").filter(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key: one partial aggregate, so hot keys shrink before the shuffle."""
    names = df.columns
    grouped = df.groupBy(*[k.alias(f"__g{i}") for i, k in enumerate(keys)])
    return grouped.agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in names])
