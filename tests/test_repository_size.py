"""The repository's formats at some size, and a repository of tables that repeat their rows."""

import hashlib
import os
import time

import duckdb
import numpy as np
import pytest

from strandline.plans import catalogue
from strandline.sources import formats as X
from strandline.sources import packs as P
from strandline.sources import repository as R
from strandline.sources import writers as W

SF = "/root/testdata/sf0.001"


def seconds(f):
    began = time.perf_counter()
    out = f()
    return out, time.perf_counter() - began


def test_directory_index_grows_in_proportion():
    """A quadratic writer takes a minute for these; the time is that of appending them once."""
    entries = [{"name": f"a/b/{i // 7:09d}{'x' * (i % 7)}", "mode": 0o100644, "id": f"{i:040x}", "mtime_ns": i} for i in range(60_000)]
    data, took = seconds(lambda: X.directory_bytes(iter(entries), 4, count=len(entries)))
    assert took < 15
    assert [(e["name"], e["id"], e["mtime_ns"]) for e in X.directory_rows(data)] == [(e["name"], e["id"], e["mtime_ns"]) for e in entries]


def test_delta_of_large_bodies_grows_in_proportion():
    import random

    r = random.Random(1)
    base, target = (r.randbytes(12_000_000) for _ in range(2))
    delta, took = seconds(lambda: P.copy_delta(base, target))
    assert took < 10 and P.apply_copy_delta(base, delta) == target


@pytest.mark.parametrize("bits", [0, 1, 64, 65, 3000])
def test_bitmap_of_words(bits):
    some = {i for i in range(bits) if i * i % 7 < 3}
    assert X.ewah_bits(X.ewah_encode(some, bits)) == (sorted(some), bits, len(X.ewah_encode(some, bits)))


def test_many_ids_at_once(tmp_path):
    """Ids that end in zeros too, in indexes of both versions, and the first place of an id in several packs."""
    ids = sorted({hashlib.sha1(b"%d" % i).digest() for i in range(500)} | {b"\x05" * 19 + b"\0", b"\x05" * 18 + b"\0\0"})
    rows = [{"id": x.hex(), "offset": 12 + 3 * k, "crc32": k} for k, x in enumerate(reversed(ids))]
    halves = {"a.idx": rows[:300], "b.idx": rows[200:], "c.idx": []}
    for name, some in halves.items():
        (tmp_path / name).write_bytes(X.write_index(some, b"\0" * 20))
    one = sorted(rows, key=lambda r: r["id"])
    fan = np.cumsum(np.bincount([int(r["id"][:2], 16) for r in one], minlength=256)).astype(">u4").tobytes()
    (tmp_path / "old.idx").write_bytes(fan + b"".join(r["offset"].to_bytes(4, "big") + bytes.fromhex(r["id"]) for r in one) + b"\0" * 40)
    packs = {name: P.PackIndex(str(tmp_path / name)) for name in (*halves, "old.idx")}
    asked = np.array([*ids, b"\0" * 20, b"\xff" * 20, b"\x05" * 20], "S20")
    for index in packs.values():
        assert index.holds(asked).tolist() == [index.find(x) is not None for x in [*ids, b"\0" * 20, b"\xff" * 20, b"\x05" * 20]]
    want = {r["id"]: (name, r["offset"]) for name in reversed(halves) for r in halves[name]}
    got = list(X.multi_pack_rows(P.multi_pack_bytes({n: packs[n] for n in halves})))
    assert got == [(i, *want[i]) for i in sorted(want)]


def test_ranges_without_a_type_are_no_tasks(tmp_path):
    root = W.init(str(tmp_path))
    objects = [("blob", b"%d" % i) for i in range(R.RANGE)] + [("tree", b""), ("blob", b"x")]
    P.write_pack(os.path.join(root, "objects", "pack"), objects)
    for table, firsts in (("objects", [0, R.RANGE]), ("tree_entries", [R.RANGE]), ("commits", [])):
        reader = R.RepositoryReader(table, str(tmp_path), "sha1")
        parts = reader.partitions()
        assert [p.value for p in parts if p.kind == "pack"] == firsts
        if table == "objects":
            assert len({r[0] for p in parts for r in reader.read(p)}) == len(objects)
            reader.type = "tree"
            assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["tree"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["repo_paths", "repo_pack_index", "repo_pack_types", "repo_reverse_index", "repo_index_entries", "repo_tree_entries", "repo_object_count"])
def test_repeated_customers(spark, tmp_path_factory, name):
    """Every customer thrice under other keys: equal objects are in a pack once, equal files in a folder thrice."""
    folder = tmp_path_factory.getbasetemp() / "repeated"
    con = duckdb.connect()
    if not folder.exists():
        folder.mkdir()
        con.execute(f"COPY (SELECT * REPLACE (c_custkey + k AS c_custkey) FROM '{SF}/customer.parquet', (VALUES (0), (150), (301)) t(k)) TO '{folder}/customer.parquet'")
        for t in ("nation", "region"):
            con.execute(f"COPY (FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet'")
    for t in ("customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    got = catalogue.queries()[name](spark, str(folder)).toPandas()
    columns = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name]).df()
    plain = lambda f: sorted(tuple(map(str, r)) for r in f[columns].itertuples(index=False))
    assert plain(got) == plain(want)
