"""A query of the repository waits for the parts that it reads, and gives the rows of the whole one."""

import os
import shutil

import duckdb
import pytest

from strandline.plans import catalogue
from strandline.plans import repository as Q
from strandline.sources import packs as P
from strandline.sources import repository as R
from strandline.sources import writers as W

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

#: What a query of a new folder of tables leaves written.
WRITTEN = {
    "repo_reflog": {"history"},
    "repo_refs": {"history"},
    "repo_stash": {"history"},
    "repo_commit_graph": {"history"},
    "repo_branches": {"history"},
    "repo_resolved_refs": {"history"},
    "repo_remotes": {"settings"},
    "repo_objects": {"history", "packs", "loose"},
    "repo_object_count": {"history", "packs", "loose"},
    "repo_lookup": {"history", "packs", "loose"},
    "repo_reverse_index": {"history", "packs"},
    "repo_pack_types": {"history", "packs"},
}


def parts(path: str) -> set[str]:
    """Parts of a repository, told by their files."""
    at = lambda *p: os.path.join(path, ".git", *p)
    loose = sum(len(os.listdir(at("objects", d))) for d in os.listdir(at("objects")) if len(d) == 2)
    there = {"history": os.path.exists(at("logs", "refs", "stash")), "packs": any(n.endswith(".pack") for n in os.listdir(at("objects", "pack"))), "loose": loose > 1}
    return {k for k, v in {**there, "settings": os.path.exists(at("more")), "index": os.path.exists(at("index"))}.items() if v}


def plain(frame, columns):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", WRITTEN)
def test_parts_of_a_query(spark, tmp_path, monkeypatch, name):
    con, folders, make = duckdb.connect(), [], Q.local_path
    for t in ("customer", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    monkeypatch.setattr(Q, "local_path", lambda *a: folders.append(make(*a)) or folders[-1])
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert plain(got, sorted(got.columns)) == plain(want, sorted(want.columns))
    assert parts(folders[0]) == WRITTEN[name]
    assert catalogue.queries()["repo_fsck"](spark, str(tmp_path)).first()["problems"] == 0  # the rest follows
    assert len(folders) == 2 and parts(folders[0]) >= {"history", "packs", "loose"}


def test_lookup_lists_no_ids(spark, tmp_path, monkeypatch):
    """The two ids are found through names and fan-outs; a list of all ids is not made."""
    for t in ("customer", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    tables, load = [], R.load
    monkeypatch.setattr(R, "load", lambda *a: tables.append(a[2]) or load(*a))
    assert catalogue.queries()["repo_lookup"](spark, str(tmp_path)).count() == 2
    assert "object_ids" not in tables


def test_objects_are_dealt_to_all_cores(spark):
    """Partitions of some megabytes are not put together, and none holds more rows than one may."""
    cores = spark.sparkContext.defaultParallelism
    rows = lambda n: Q._dealt(spark.range(n).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS content")).groupBy("content").count()
    sizes = lambda n: [r["n"] for r in rows(n).selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert len(sizes(40_000)) == cores and len(sizes(100)) == 1 and max(sizes(300_000)) < 70_000


def test_indexes_are_read_as_batches(tmp_path):
    import pyarrow as pa

    root = W.init(str(tmp_path))
    objects = [("blob", b"%d" % i) for i in range(300)] + [("tree", b"")]
    pack = P.write_pack(os.path.join(root, "objects", "pack"), objects)
    index = P.PackIndex(pack.removesuffix(".pack") + ".idx")
    want = {index.id_at(i).hex() for i in range(index.count)}
    for table in ("object_ids", "pack_index", "pack_types", "reverse_index"):
        reader = R.RepositoryReader(table, str(tmp_path), "sha1")
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert all(isinstance(b, pa.RecordBatch) for b in batches)
        assert {x for b in batches for x in b.column("id").to_pylist()} == want and sum(b.num_rows for b in batches) == len(want)


def test_ids_that_end_in_zeros():
    import numpy as np

    ids = [b"\x05" * 19 + b"\0", b"\0" * 20, b"\xff" * 20]
    assert R._hex(np.array(ids, "S20")).to_pylist() == [x.hex() for x in ids]
