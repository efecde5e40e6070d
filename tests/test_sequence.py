import pytest
from pyspark.sql import functions as F

from strandline.operators.sequence import By, Sequence, with_ordinal


@pytest.fixture(scope="module")
def letters(spark):
    return Sequence.of(spark, [("b", 2), ("A", 1), ("a", None), ("B", 4), ("c", 2)], "k string, v int")


def values(s, *names):
    return [tuple(r[n] for n in names) for r in s.to_list()]


def test_stable_order_and_nulls(letters):
    assert [v for (v,) in values(letters.order_by(F.col("v")), "v")] == [None, 1, 2, 2, 4]
    assert [k for (k,) in values(letters.order_by(F.col("v"), descending=True), "k")] == ["B", "b", "c", "A", "a"]
    assert [k for (k,) in values(letters.order_by(F.lower("k")).then_by(F.col("v"), descending=True), "k")] == ["A", "a", "B", "b", "c"]
    assert [k for (k,) in values(letters.reverse(), "k")] == ["c", "B", "a", "A", "b"]


def test_custom_equality(letters, spark):
    other = Sequence.of(spark, [("B", 9), ("x", 9)], "k string, v int")
    by = F.lower("k")
    assert values(letters.distinct(by), "k") == [("b",), ("A",), ("c",)]
    assert values(letters.except_(other, by), "k") == [("A",), ("c",)]
    assert values(letters.intersect(other, by), "k") == [("b",)]
    assert values(letters.union(other, by), "k") == [("b",), ("A",), ("c",), ("x",)]
    assert len(values(letters.concat(other), "k")) == 7
    groups = {r["key"]: r["n"] for r in letters.group_by(F.col("k"), result=[F.count(F.lit(1)).alias("n")], equal=F.lower).collect()}
    assert groups == {"b": 2, "A": 2, "c": 1}


def test_slices(letters):
    assert values(letters.take(2), "k") == [("b",), ("A",)]
    assert values(letters.skip(3), "k") == [("B",), ("c",)]
    assert values(letters.take_while(F.col("v") < 3), "k") == [("b",), ("A",)]  # a null test is false
    assert values(letters.skip_while(F.col("v") < 3), "k") == [("a",), ("B",), ("c",)]
    assert values(letters.take_while(F.col("v") < 100).skip(5), "k") == []
    assert values(letters.where(lambda i: i % 2 == 1), "k") == [("A",), ("B",)]


def test_positions_after_other_operators(letters, spark):
    """Positions are those of the sequence at hand, not of one that it came from."""
    assert values(letters.reverse().where(lambda i: i < 2), "k") == [("c",), ("B",)]
    assert values(letters.skip(1).skip(1).where(lambda i: i == 0), "k") == [("a",)]
    assert values(letters.order_by(F.col("v")).skip(3), "k") == [("c",), ("B",)]
    assert sorted(map(tuple, letters.reverse().zip(Sequence.of(spark, [(10,), (20,)], "w int")).select("k", "w").collect())) == [("B", 20), ("c", 10)]
    assert not letters.sequence_equal(letters.reverse()) and letters.reverse().reverse().sequence_equal(letters)
    assert not letters.sequence_equal(letters.take(4)) and not letters.take(4).sequence_equal(letters)


def test_positions_by_ranges(spark):
    """Ranges of the whole order: one hot first key, nulls, and falling keys."""
    rows = [(None if i % 11 == 0 else 5 if i % 3 else i % 7, f"t{i * 37 % 500:03d}" if i % 13 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, id long").repartition(3)
    for falling in (False, True):
        order = [By(F.col("a"), falling), By(F.col("b"), not falling), By(F.col("id"))]
        one, many = (with_ordinal(df, order, "n", size).select("id", "n").orderBy("id").collect() for size in (1 << 40, 0))
        assert one == many and sorted(r["n"] for r in many) == list(range(500))


def test_joins(letters, spark):
    pairs = letters.zip(Sequence.of(spark, [(10,), (20,)], "w int")).select("k", "w").collect()
    assert sorted(map(tuple, pairs)) == [("A", 20), ("b", 10)]
    inner = Sequence.of(spark, [(2, "p"), (2, "q"), (None, "n")], "v2 int, e string")
    lists = {r["k"]: r["matches"] for r in letters.group_join(inner, F.col("v"), F.col("v2"), F.col("e")).collect()}
    assert lists == {"b": ["p", "q"], "A": [], "a": [], "B": [], "c": ["p", "q"]}


def test_terminals(letters, spark):
    assert letters.count() == 5 and letters.count(F.col("v") == 2) == 2
    assert letters.any() and not letters.any(F.col("v") > 9) and not letters.all(F.col("v") > 0)
    assert letters.first()["k"] == "b" and letters.last()["k"] == "c" and letters.element_at(3)["k"] == "B"
    assert letters.single(F.col("v") == 4)["k"] == "B" and letters.contains(F.col("k"), "a")
    assert letters.first_or_none(F.col("v") > 9) is None and letters.fold(F.sum("v")) == 9
    with pytest.raises(LookupError):
        letters.first(F.col("v") > 9)
    with pytest.raises(LookupError):
        letters.single(F.col("v") == 2)
    assert letters.sequence_equal(letters) and not letters.sequence_equal(letters.reverse().indexed().take(4))
    empty = letters.where(F.lit(False))
    assert values(empty.default_if_empty(k="none"), "k", "v") == [("none", None)] and values(letters.default_if_empty(k="none").take(9), "k")[0] == ("b",)


@pytest.mark.parametrize("descending", [False, True])
def test_ordinals_by_ranges(spark, descending):
    df = spark.range(5000).select(F.when(F.col("id") % 50 != 0, (F.col("id") * 7919) % 1000).alias("k"), "id")
    order = [By(F.col("k"), descending), By(F.col("id"))]
    small = {r["id"]: r["p"] for r in with_ordinal(df, order, "p").collect()}
    ranged = {r["id"]: r["p"] for r in with_ordinal(df, order, "p", one_task_bytes=0).collect()}
    assert small == ranged and sorted(ranged.values()) == list(range(5000))
