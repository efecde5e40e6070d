"""Every registered query of the engine against its DuckDB equivalent."""

import os

import duckdb
import pytest

from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return None
        return round(v, 6) if isinstance(v, float) and not v.is_integer() else int(v) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_long_hashes(spark, db):
    import hashlib

    text = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in catalogue.queries()["long_hashes"](spark, SF).collect():
        raw = text[r["doc_id"]].encode()
        assert (r["sha384"], r["sha512"]) == (hashlib.sha384(raw).hexdigest(), hashlib.sha512(raw).hexdigest())


@pytest.mark.parametrize("name", ["diff_lines", "similarity"])
def test_differences_of_neighbours(spark, db, name):
    """Chunks cover both texts, kept lines are equal and as many as those of a longest common subsequence."""
    text = db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    pairs = {a: (x.split("\n"), y.split("\n")) for (a, x), (_, y) in zip(text, text[1:], strict=False)}
    found = {}
    for r in catalogue.queries()[name](spark, SF).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(pairs)
    for d, (a, b) in pairs.items():
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
            before = row
        if name == "similarity":
            assert found[d][0]["has_changes"] == (a != b) and 0 <= found[d][0]["similarity"] <= 1
            continue
        rows = sorted(found[d], key=lambda r: (r["orig_start"], r["mod_start"]))
        assert sum(r["orig_end"] - r["orig_start"] for r in rows) == len(a) and sum(r["mod_end"] - r["mod_start"] for r in rows) == len(b)
        kept = [r for r in rows if not r["changed"]]
        assert all(a[r["orig_start"] : r["orig_end"]] == b[r["mod_start"] : r["mod_end"]] for r in kept) and sum(r["orig_end"] - r["orig_start"] for r in kept) == before[-1]
