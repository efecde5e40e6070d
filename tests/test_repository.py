"""Readers and writers on a repository made here, in all its storage forms."""

import os

import pytest

from strandline.sources import formats as X
from strandline.sources import packs as P
from strandline.sources import repository as R
from strandline.sources import writers as W

FILES = "iota A/mu A/B/lambda A/B/E/alpha A/B/E/beta A/D/gamma A/D/G/pi A/D/G/rho A/D/G/tau A/D/H/chi A/D/H/psi A/D/H/omega".split()
WHO = "BH <bh@BH> 946681200 +0100"


def stream() -> bytes:
    out = []
    for i, f in enumerate(FILES, 1):
        text = f"This is the file '{f.split('/')[-1]}'.\n"
        out.append(f"blob\nmark :{i}\ndata {len(text)}\n{text}\n")
    moves = "".join(f"M 100644 :{i} {f}\n" for i, f in enumerate(FILES, 1))
    out.append(f"commit refs/heads/master\nmark :20\nauthor {WHO}\ncommitter {WHO}\ndata 15\nInitial Commit\n{moves}\n")
    out.append(f"commit refs/heads/side\nmark :21\ncommitter {WHO}\ndata 14\nSecond Commit\nfrom :20\nM 100644 inline A/C/delta\ndata 2\nd\n\nD iota\n\n")
    out.append(f"commit refs/heads/master\nmark :22\ncommitter {WHO}\ndata 7\nMerged\nfrom :20\nmerge :21\nM 100644 :1 A/C/delta\n\n")
    out.append(f"tag v0.1\nfrom :21\ntagger {WHO}\ndata 18\nTag second Commit\n")
    return "".join(out).encode()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repo"))
    refs = W.fast_import(W.init(path), stream())
    return path, refs


def test_ids_of_known_contents():
    assert X.hash_object("blob", b"This is 'iota'.") == "ce5beb5e8714fe6d04096988a48589e8312451a8"
    assert X.hash_object("tree", W.tree_bytes([(W.FILE, "iota", "ce5beb5e8714fe6d04096988a48589e8312451a8")])) == "f6315a2112111a87d565eef0175d25ed01c7da6e"


def test_commits_trees_tags(spark, repo):
    path, refs = repo
    commits = {r["id"]: r for r in R.load(spark, path, "commits").collect()}
    assert len(commits) == 3
    merge = commits[refs["refs/heads/master"]]
    assert merge["parent_count"] == 2 and merge["summary"] == "Merged" and merge["author"]["tz_offset_min"] == 60
    assert R.load(spark, path, "commit_parents").count() == 3
    tag = R.load(spark, path, "tag_objects").first()
    assert tag["name"] == "v0.1" and tag["object_id"] == refs["refs/heads/side"]
    from strandline.operators.graph import flatten_tree

    entries = R.load(spark, path, "tree_entries")
    paths = {r["path"] for r in flatten_tree(entries, spark.createDataFrame([(merge["tree_id"],)], "tree_id string")).collect()}
    assert paths == {*FILES, "A/C/delta"}


def test_refs_logs_config(spark, repo):
    path, refs = repo
    names = {r["name"]: r for r in R.load(spark, path, "refs").collect()}
    assert names["HEAD"]["symbolic_target"] == "refs/heads/master" and names["refs/tags/v0.1"]["id"] == refs["refs/tags/v0.1"]
    W.update_references(os.path.join(path, ".git"), [("refs/heads/new", refs["refs/heads/side"], None)], WHO, "branch: made")
    log = R.load(spark, path, "reflog").collect()
    assert [(r["ref_name"], r["original_id"], r["reason"]) for r in log] == [("refs/heads/new", "0" * 40, "branch: made")]
    with pytest.raises(ValueError):
        W.update_references(os.path.join(path, ".git"), [("refs/heads/new", refs["refs/heads/side"], None)], WHO, "again")
    assert ("core", None, "bare", "false") in [tuple(r) for r in R.load(spark, path, "config").collect()]


def test_pack_index_and_pushed_filters(spark, repo, tmp_path):
    path, _ = repo
    loose = R.load(spark, path, "objects").collect()
    root = W.init(str(tmp_path))
    data = W.pack_bytes([(r["type"], bytes(r["content"])) for r in loose])
    objects = X.pack_objects(data)
    with open(os.path.join(root, "objects/pack/pack-x.pack"), "wb") as f:
        f.write(data)
    index = X.write_index(objects, data[-20:])
    with open(os.path.join(root, "objects/pack/pack-x.idx"), "wb") as f:
        f.write(index)
    packed = R.load(spark, str(tmp_path), "objects")
    assert {(r["id"], bytes(r["content"])) for r in packed.collect()} == {(r["id"], bytes(r["content"])) for r in loose}
    assert packed.filter("type = 'commit'").count() == 3
    rows = R.load(spark, str(tmp_path), "pack_index").collect()
    assert [(r["id"], r["offset"], r["crc32"]) for r in sorted(rows, key=lambda r: r["id"])] == [(o["id"], o["offset"], o["crc32"]) for o in sorted(objects, key=lambda o: o["id"])]
    assert X.reverse_index(objects, data[-20:])[:4] == b"RIDX"


def test_objects_of_several_places(spark, repo, tmp_path):
    """Each object once, whether loose, in packs with and without an index, or with bases elsewhere; ids lead to them."""
    path, _ = repo
    loose = sorted((r["id"], r["type"], bytes(r["content"])) for r in R.load(spark, path, "objects").collect())
    rows = [(t, b) for _, t, b in loose]
    root = W.init(str(tmp_path))
    folder = os.path.join(root, "objects", "pack")
    P.write_pack(folder, rows[:10])
    P.write_pack(folder, rows[5:], deltas=False)
    for end in (".idx", ".rev", ".bitmap"):
        os.remove(P.write_pack(folder, rows[3:9] + rows[-2:]).removesuffix(".pack") + end)
    for kind, body in rows[::3]:
        W.write_object(root, kind, body)
    got = R.load(spark, str(tmp_path), "objects")
    assert sorted((r["id"], r["type"], bytes(r["content"])) for r in got.collect()) == loose
    assert R.object_count(spark, str(tmp_path)) == len(loose)
    for kind in ("blob", "commit", "tag", "tree"):
        assert {r["id"] for r in got.filter(f"type = '{kind}'").collect()} == {i for i, t, _ in loose if t == kind}
    for id_, kind, body in loose:
        assert P.Store(root).read(bytes.fromhex(id_)) == (kind, body)
    assert [(r["id"], r["type"]) for r in got.filter(f"id = '{loose[4][0]}'").collect()] == [loose[4][:2]] and got.filter("id = 'no'").collect() == []
    index = P.PackIndex(next(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".idx")))
    ids = [index.id_at(i) for i in range(index.count)]
    assert [index.find(x) for x in ids] == index.offsets().tolist() and index.find(b"\0" * 20) is None
    for head in (ids[0][:1], ids[-1][:2]):
        a, b = index.span(head)
        assert ids[a:b] == [x for x in ids if x.startswith(head)]


def test_bases_outside_a_pack_and_large_packs(tmp_path):
    import struct
    import zlib

    root = W.init(str(tmp_path))
    base = b"0123456789" * 30
    id_ = W.write_object(root, "blob", base)
    target = base[:100] + b"new" + base[100:]
    delta = P.copy_delta(base, target)
    frame = bytes([X.ID_DELTA << 4 | len(delta) & 15 | (128 if len(delta) > 15 else 0)]) + (bytes([len(delta) >> 4]) if len(delta) > 15 else b"") + bytes.fromhex(id_) + zlib.compress(delta)
    data = b"PACK" + struct.pack(">II", 2, 1) + frame
    folder = os.path.join(root, "objects", "pack")
    rows = [{"id": X.hash_object("blob", target), "offset": 12, "crc32": zlib.crc32(frame)}]
    for end, raw in ((".pack", data + b"\0" * 20), (".idx", X.write_index(rows, b"\0" * 20))):
        with open(os.path.join(folder, "pack-thin" + end), "wb") as f:
            f.write(raw)
    assert P.Store(root).read(bytes.fromhex(rows[0]["id"])) == ("blob", target)
    bodies = [b"line %d\n" % i * 3 for i in range(P.RANGE + 50)]
    pack = P.Pack(P.write_pack(folder, [("blob", b) for b in bodies]))
    assert [b for _, _, b in pack.objects(P.RANGE, 100)] == bodies[P.RANGE :] and len(list(pack.objects(0, P.RANGE))) == P.RANGE


def test_reference_changes_are_all_or_none(tmp_path, monkeypatch):
    root = W.init(str(tmp_path))
    a, b = "a" * 40, "b" * 40
    W.update_references(root, [("refs/heads/x", a, None), ("refs/heads/y", a, None)], WHO, "made")
    with open(os.path.join(root, "packed-refs"), "w") as f:
        f.write(f"{b} refs/heads/x\n{b} refs/heads/z\n")
    files = lambda: {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}
    before = files()
    with pytest.raises(ValueError):
        W.update_references(root, [("refs/heads/x", b, a), ("refs/heads/z", a, None)], WHO, "z is there")
    assert files() == before
    done = os.replace
    monkeypatch.setattr(W.os, "replace", lambda x, y: done(x, y) if not y.endswith("heads/y") else (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        W.update_references(root, [("refs/heads/x", b, a), ("refs/heads/z", None, b), ("refs/heads/y", b, a)], WHO, "half")
    monkeypatch.setattr(W.os, "replace", done)
    assert {n: t for n, t in files().items() if not n.endswith(".new")} == before
    W.update_references(root, [("refs/heads/x", None, a), ("refs/heads/z", a, b)], WHO, "moved")
    now = files()
    assert "refs/heads/x" not in now and "refs/heads/x" not in now["packed-refs"] and now["refs/heads/z"] == a + "\n" and now["logs/refs/heads/x"].endswith(f"{a} {'0' * 40} {WHO}\tmoved\n")


def test_repack_and_packed_references(spark, tmp_path):
    path = str(tmp_path)
    refs = W.fast_import(W.init(path), stream())
    root = os.path.join(path, ".git")
    before = sorted(tuple(r) for r in R.load(spark, path, "objects").select("id", "type", "size").collect())
    names = {r["name"]: r["id"] for r in R.load(spark, path, "refs").collect()}
    assert W.pack_references(root) == 3 and os.path.exists(W.repack(root)) and os.path.exists(W.repack(root))
    assert os.listdir(os.path.join(root, "refs", "heads")) == [] and [n for n in os.listdir(os.path.join(root, "objects")) if len(n) == 2] == []
    rows = {r["name"]: (r["id"], r["peeled_id"]) for r in R.load(spark, path, "refs").collect()}
    assert {n: i for n, (i, _) in rows.items()} == names and rows["refs/tags/v0.1"][1] == refs["refs/heads/side"]
    assert sorted(tuple(r) for r in R.load(spark, path, "objects").select("id", "type", "size").collect()) == before


def test_object_sink(spark, tmp_path):
    root = W.init(str(tmp_path))
    df = spark.createDataFrame([("blob", bytearray(b"This is 'iota'."))] * 3, "type string, content binary")
    W.save_objects(df, str(tmp_path))
    assert os.path.exists(os.path.join(root, "objects/ce/5beb5e8714fe6d04096988a48589e8312451a8"))
    assert R.load(spark, str(tmp_path), "objects").filter("id = 'ce5beb5e8714fe6d04096988a48589e8312451a8'").count() == 1


@pytest.mark.parametrize("version", [2, 4])
@pytest.mark.parametrize("algorithm", ["sha1", "sha256"])
def test_directory_index(version, algorithm):
    entries = [{"name": f, "mode": W.FILE, "id": X.hash_object("blob", f.encode(), algorithm), "stage": i % 2, "mtime_ns": 5 * 10**9 + i} for i, f in enumerate(sorted(FILES))]
    got = list(X.directory_rows(X.directory_bytes(entries, version, algorithm), X.id_bytes(algorithm)))
    assert [(g["name"], g["id"], g["stage"], g["mtime_ns"]) for g in got] == [(e["name"], e["id"], e["stage"], e["mtime_ns"]) for e in entries]
    full = X.directory_bytes(entries, version, algorithm, [("TREE", b"x" * 300), ("sdir", b"")])
    size = X.id_bytes(algorithm)
    assert [n for n, _ in X.directory_extensions(full, size)] == ["TREE", "sdir", "EOIE"] and X._end_of_entries(full, size) == X._directory(full, size)[1]
    assert X._end_of_entries(full.replace(b"sdir", b"sdis"), size) is None and X.directory_extensions(X.directory_bytes(entries, version, algorithm), size) == []
    link = b"\7" * size + X.ewah_encode({2, 70}, 90) + X.ewah_encode({1}, 90)
    assert X.split_link(link, size) == ("07" * size, [2, 70], [1]) and X.split_link(b"\7" * size, size) == ("07" * size, [], [])
    split = X.merge_split_index(got, {0}, {1: {"id": "ff"}}, [got[0] | {"name": "zz"}])
    assert len(split) == len(got) and split[-1]["name"] == "zz" and {"ff"} < {e["id"] for e in split}


def test_delta_entries_in_packs():
    import struct
    import zlib

    base = b"0123456789" * 10
    delta = bytes([100, 104, 0x90, 100, 4]) + b"tail"
    first = bytes([0x80 | 3 << 4 | 100 & 15, 100 >> 4]) + zlib.compress(base)
    second = bytes([6 << 4 | len(delta)]) + bytes([len(first)]) + zlib.compress(delta)
    got = X.pack_objects(b"PACK" + struct.pack(">II", 2, 2) + first + second + b"\0" * 20)
    assert [o["body"] for o in got] == [base, base + b"tail"] and got[1]["depth"] == 1


def test_small_formats():
    bits = set(range(0, 2369, 3))
    got, n, end = X.ewah_bits(X.ewah_encode(bits, 2369))
    assert set(got) == bits and n == 2369 and end == len(X.ewah_encode(bits, 2369))
    assert list(X.packed_ref_rows("# pack-refs\n" + "a" * 40 + " refs/tags/x\n^" + "b" * 40 + "\n" + "c" * 40 + " refs/heads/y\n")) == [("refs/tags/x", "a" * 40, "b" * 40), ("refs/heads/y", "c" * 40, None)]
    assert list(X.config_rows('[remote "or\\"igin"]\n\turl = a "b ; c" # note\n\tflag\n')) == [("remote", 'or"igin', "url", "a b ; c"), ("remote", 'or"igin', "flag", None)]
    assert list(X.packet_lines(b"0009hello0000")) == [b"hello", None]
    assert X.hash_dump(b"K 3\nabc\nV 2\nxy\nEND\n") == {"abc": b"xy"}
    assert X.header_rows("a: 1\nb: 2\n\nc: 3") == {"a": "1", "b": "2"}
    b = X.bundle_rows(b"# v3 git bundle\n@object-format=sha1\n-" + b"a" * 40 + b" why\n" + b"b" * 40 + b" refs/heads/m\n\nPACK")
    assert b["version"] == 3 and b["prerequisites"] == [("a" * 40, "why")] and b["references"] == [("b" * 40, "refs/heads/m")] and b["pack"] == b"PACK"


def test_signed_commit_parts():
    body = b"tree " + b"a" * 40 + b"\nauthor A <a@b> 1 +0000\ncommitter A <a@b> 1 +0000\ngpgsig -----BEGIN\n line\n\nmessage\n"
    assert X.commit_row(body)["is_signed"] and b"gpgsig" not in X.signed_portion(body) and b" line" not in X.signed_portion(body)


def test_revision_file_and_http():
    delta = b"SVN\0" + bytes([0, 5, 6, 3, 1]) + bytes([5, 0, 2 << 6 | 1]) + b"!"
    data = b"PLAIN\nK 1\nENDREP\nDELTA 3 10 20\n" + delta + b"ENDREP\nid: x\n"
    assert list(X.revision_file_rows(data, lambda r, o, n: b"hello")) == [("PLAIN", b"K 1\n"), ("DELTA", b"hello!")]
    import gzip

    body = gzip.compress(b"hi")
    raw = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    assert X.http_response(raw) == {"status": 200, "headers": {"content-encoding": "gzip", "transfer-encoding": "chunked"}, "body": b"hi"}


def test_graph_files():
    import struct

    ids = [bytes([i]) * 20 for i in (1, 2, 3, 4)]
    fan = b"".join(struct.pack(">I", sum(x[0] <= b for x in ids)) for b in range(256))
    none, extra = 0x70000000, 0x80000000
    rows = [(none, none, 1), (0, none, 2), (0, none, 2), (2, extra, 3)]
    cdat = b"".join(b"\x09" * 20 + struct.pack(">IIII", a, b, g << 2, 1000 + g) for a, b, g in rows)
    edge = struct.pack(">II", 1, extra | 0)
    chunks = [(b"OIDF", fan), (b"OIDL", b"".join(ids)), (b"CDAT", cdat), (b"EDGE", edge), (b"GDA2", struct.pack(">4I", 0, 1, 2, 3))]
    at, toc = 8 + 12 * (len(chunks) + 1), b""
    for name, c in chunks:
        toc += name + struct.pack(">Q", at)
        at += len(c)
    data = b"CGPH" + bytes([1, 1, len(chunks), 0]) + toc + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(c for _, c in chunks)
    got = list(X.commit_graph_rows(data))
    assert [(r["generation"], r["commit_time"], r["corrected_time"]) for r in got] == [(1, 1001, 1001), (2, 1002, 1003), (2, 1002, 1004), (3, 1003, 1006)]
    assert got[3]["parent_ids"] == [ids[2].hex(), ids[1].hex(), ids[0].hex()] and got[0]["parent_ids"] == []
    chunks = [(b"OIDF", fan), (b"OIDL", b"".join(ids)), (b"OOFF", struct.pack(">8I", 0, 12, 1, 40, 0, 99, 1, extra)), (b"PNAM", b"a.idx\0b.idx\0\0\0"), (b"LOFF", struct.pack(">Q", 1 << 33))]
    at, toc = 12 + 12 * (len(chunks) + 1), b""
    for name, c in chunks:
        toc += name + struct.pack(">Q", at)
        at += len(c)
    data = b"MIDX" + bytes([1, 1, len(chunks), 0]) + struct.pack(">I", 2) + toc + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(c for _, c in chunks)
    assert [(p, o) for _, p, o in X.multi_pack_rows(data)] == [("a.idx", 12), ("b.idx", 40), ("a.idx", 99), ("b.idx", 1 << 33)]


def test_bitmap_types():
    sets = [{0, 3}, {1, 70}, {2}, set()]
    data = b"BITM" + b"\0\1\0\1" + b"\0\0\0\0" + b"\7" * 20 + b"".join(X.ewah_encode(s, 71) for s in sets)
    assert X.pack_bitmap_types(data) == {"commit": [0, 3], "tree": [1, 70], "blob": [2], "tag": []}


def test_views(spark, repo, tmp_path):
    path, refs = repo
    table = R.load(spark, path, "refs")
    assert {r["name"] for r in R.branches(table).collect()} >= {"refs/heads/master", "refs/heads/side"}
    assert [(r["name"], r["object_id"]) for r in R.tags(table, R.load(spark, path, "tag_objects")).collect()] == [("refs/tags/v0.1", refs["refs/heads/side"])]
    root = W.init(str(tmp_path))
    (tmp_path / "more").write_text('[remote "up"]\n\turl = second\n')
    with open(os.path.join(root, "config"), "a") as f:
        f.write(f'[remote "up"]\n\turl = first\n\tfetch = x\n[include]\n\tpath = {tmp_path}/more\n[includeIf "gitdir:/nowhere/"]\n\tpath = {tmp_path}/more\n')
    config = R.load(spark, str(tmp_path), "config")
    assert [tuple(r) for r in R.remotes(config).collect()] == [("up", "second")]
    log = os.path.join(root, "logs/refs/stash")
    os.makedirs(os.path.dirname(log))
    with open(log, "w") as f:
        f.write(f"{'0' * 40} {'a' * 40} {WHO}\tWIP one\n{'a' * 40} {'b' * 40} {WHO}\tWIP two\n")
    rows = {r["position"]: r["reason"] for r in R.stashes(R.load(spark, str(tmp_path), "reflog")).collect()}
    assert rows == {0: "WIP two", 1: "WIP one"}
