"""A Python data source that reads a repository folder as tables.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("table", "commits").load(path)

Ranges of a pack's offset order, every eight of the 256 folders of loose objects
and each small file are partitions.  An object that lies in several places is
returned by the first that is asked (loose objects, packs by name, then those
of alternates): each task looks its ids up in the indexes of the places before,
so no shuffle is needed.  Filters ``type = ..`` and ``id = ..`` are taken by
the reader where Spark's filter pushdown for Python sources is on: an id is
found through file names and index fan-outs, a type through a pack's bitmaps or
the heads of its entries, without other bodies.

Tables of single files (bundles, framed lines, dumps, revision files) take a
file or a folder of files as their path.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from . import formats as X
from .packs import RANGE, Pack, PackIndex, Store, bitmap_positions

SIGNATURE = "struct<name:string,email:string,epoch:bigint,tz_offset_min:int>"
SCHEMAS = {
    "objects": "id string, type string, size bigint, source string, content binary",
    "object_ids": "id string, source string",
    "commits": f"id string, tree_id string, parent_ids array<string>, parent_count int, author {SIGNATURE}, committer {SIGNATURE}, message string, summary string, is_signed boolean, merge_tags array<string>",
    "commit_parents": "commit_id string, parent_index int, parent_id string",
    "tree_entries": "tree_id string, ordinal int, mode int, name string, object_id string",
    "tag_objects": f"id string, object_id string, object_type string, name string, tagger {SIGNATURE}, message string, summary string, is_signed boolean",
    "refs": "name string, id string, symbolic_target string, peeled_id string, source string",
    "reflog": f"ref_name string, seq int, original_id string, target_id string, signature {SIGNATURE}, reason string",
    "config": "group string, subgroup string, key string, value string",
    "index_entries": "name string, mode int, id string, flags bigint, stage int, ctime_ns bigint, mtime_ns bigint, dev bigint, inode bigint, uid bigint, gid bigint, truncated_size bigint",
    "pack_index": "pack string, id string, offset bigint, crc32 bigint",
    "commit_graph": "id string, tree_id string, parent_ids array<string>, generation bigint, commit_time bigint, corrected_time bigint",
    "multi_pack_index": "id string, pack string, offset bigint",
    "reverse_index": "pack string, pack_position bigint, index_position bigint, id string",
    "pack_types": "pack string, pack_position bigint, id string, type string",
    "bundle": "file string, version int, kind string, id string, name string",
    "bundle_objects": "file string, id string, type string, size bigint, content binary",
    "packet_lines": "file string, seq int, payload binary",
    "hash_dump": "file string, key string, value binary",
    "headers": "file string, key string, value string",
    "revision_texts": "file string, seq int, kind string, text binary",
}
FILE_TABLES = ("bundle", "bundle_objects", "packet_lines", "hash_dump", "headers", "revision_texts")
#: Of the 256 folders of loose objects so many are one partition.
HEADS = 8
#: Rows of an Arrow batch, and ids of a pack that one task lists.
BATCH = 65536
_OBJECT_TABLES = {"commits": "commit", "commit_parents": "commit", "tree_entries": "tree", "tag_objects": "tag"}


@dataclass
class Part(InputPartition):
    kind: str
    path: str
    value: object = field(default=None)


def _hex(ids: np.ndarray):
    """Ids, as fixed strings of bytes, in hexadecimal as an Arrow array."""
    import pyarrow as pa

    size = 2 * ids.dtype.itemsize
    ends = np.arange(len(ids) + 1, dtype=np.int64) * size
    return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(ids.tobytes().hex().encode())).cast(pa.string())


def _batch(table: str, *columns):
    """Rows of a table as one Arrow batch; a string stands for all rows."""
    import pyarrow as pa

    names, kinds = zip(*(c.split() for c in SCHEMAS[table].split(", ")), strict=True)
    kinds = [{"string": pa.string(), "bigint": pa.int64()}[k] for k in kinds]
    rows = next(len(c) for c in columns if not isinstance(c, str))
    return pa.RecordBatch.from_arrays([pa.repeat(c, rows) if isinstance(c, str) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=list(names))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options.get("table", "objects"), self.options["path"], self.options.get("algorithm", "sha1"))


class RepositoryReader(DataSourceReader):
    def __init__(self, table: str, path: str, algorithm: str):
        self.table, self.algorithm = table, algorithm
        git = os.path.join(path, ".git")
        self.root = git if os.path.isdir(git) else path
        self.type, self.id = _OBJECT_TABLES.get(table), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",) and self.table == "objects":
                self.type = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("id",) and self.table == "objects":
                self.id = f.value
            else:
                yield f
                continue

    def partitions(self):
        root, at = self.root, lambda *p: os.path.join(self.root, *p)
        if self.table in FILE_TABLES:
            files = [root] if os.path.isfile(root) else [os.path.join(root, n) for n in sorted(os.listdir(root)) if os.path.isfile(os.path.join(root, n))]
            return [Part(self.table, f) for f in files] or [Part("none", "")]
        if self.table == "refs":
            return [Part("refs", root)]
        if self.table == "reflog":
            return [Part("reflog", os.path.join(d, n), os.path.relpath(os.path.join(d, n), at("logs"))) for d, _, names in os.walk(at("logs")) for n in names] or [Part("none", "")]
        if self.table in ("config", "index_entries", "commit_graph", "multi_pack_index"):
            path = {"config": at("config"), "index_entries": at("index"), "commit_graph": at("objects", "info", "commit-graph"), "multi_pack_index": at("objects", "pack", "multi-pack-index")}[self.table]
            chain = at("objects", "info", "commit-graphs", "commit-graph-chain")
            if self.table == "commit_graph" and not os.path.exists(path) and os.path.exists(chain):
                return [Part("commit_graph_chain", chain)]
            return [Part(self.table if os.path.exists(path) else "none", path)]
        store = Store(root, self.algorithm)
        if self.table in ("pack_index", "reverse_index", "pack_types"):
            return [Part(self.table, p) for p in store.packs if os.path.exists(p.removesuffix(".pack") + ".idx")] or [Part("none", "")]
        if self.id is not None:
            return [Part("lookup", self.id)]
        out, step = [], BATCH if self.table == "object_ids" else RANGE
        for f in store.folders:
            heads = [os.path.join(f, n) for n in sorted(os.listdir(f)) if len(n) == 2]
            out += [Part("loose", f, heads[i : i + HEADS]) for i in range(0, len(heads), HEADS)]
        for p in store.packs:
            index = p.removesuffix(".pack") + ".idx"
            if not os.path.exists(index):
                out.append(Part("whole_pack", p))
                continue
            typed = bitmap_positions(p, self.type, store.size) if self.type else None  # ranges without the type are no tasks
            firsts = range(0, PackIndex(index, store.size).count, step) if typed is None else sorted({place // RANGE * RANGE for place in typed})
            out += [Part("pack", p, first) for first in firsts]
        return out or [Part("none", "")]

    def read(self, part: Part):
        yield from getattr(self, "_" + part.kind)(part)

    def _none(self, part):
        return ()

    # ---- objects ----

    def _lookup(self, part):
        """The object of an id."""
        if len(part.path) == 2 * X.id_bytes(self.algorithm) and all(c in "0123456789abcdef" for c in part.path):
            got = Store(self.root, self.algorithm).read(bytes.fromhex(part.path))
            if got and self.type in (None, got[0]):
                yield from self._rows(part.path, got[0], len(got[1]), "lookup", got[1])

    def _loose(self, part):
        store = Store(self.root, self.algorithm)
        before = store.earlier(part.path)
        rows = (row for folder in part.value for row in self._loose_folder(folder, store, before))
        if self.table != "object_ids":
            yield from rows
        elif ids := [id_ for id_, _ in rows]:
            yield _batch("object_ids", ids, "loose")

    def _loose_folder(self, folder: str, store: Store, before: list):
        head = os.path.basename(folder)
        for name in sorted(os.listdir(folder)):
            id_ = head + name
            if len(id_) != 2 * X.id_bytes(self.algorithm) or any(store.has(w, bytes.fromhex(id_)) for w in before):
                continue
            if self.table == "object_ids":
                yield id_, "loose"
                continue
            data = _read(os.path.join(folder, name))
            kind, size, _ = X.loose_object(data, head_only=True)
            if self.type in (None, kind):
                yield from self._rows(id_, kind, size, "loose", X.loose_object(data)[2])

    def _pack(self, part):
        store = Store(self.root, self.algorithm)
        pack, before = store.pack(part.path), store.earlier(part.path)
        typed = bitmap_positions(part.path, self.type, store.size) if self.type else None
        order = pack.index.by_offset()[part.value : part.value + (BATCH if self.table == "object_ids" else RANGE)]
        places = np.arange(part.value, part.value + len(order))
        if typed is not None:
            own = np.isin(places, np.fromiter(typed, np.int64, len(typed)))
            order, places = order[own], places[own]
        if not len(order):
            return
        own = store.first_here(before, pack.index.every_id()[order])
        if self.table == "object_ids":
            yield _batch("object_ids", _hex(pack.index.every_id()[order[own]]), "pack")
            return
        places = set(places[own].tolist())

        def wanted(id_: bytes, place: int) -> bool:
            return place in places and (self.type is None or typed is not None or pack.type_of(pack.index.find(id_)) == self.type)

        for id_, kind, body in pack.objects(part.value, RANGE, wanted):
            yield from self._rows(id_, kind, len(body), "pack", body)

    def _whole_pack(self, part):
        """A pack without an index is read from its beginning to its end, after all that have one."""
        store = Store(self.root, self.algorithm)
        bare = [p for p in store.packs if store.pack(p).index is None]
        outside = lambda id_: (lambda got: got and {"type": got[0], "body": got[1]})(store.read(bytes.fromhex(id_)))
        seen = {o["id"] for p in bare[: bare.index(part.path)] for o in X.pack_objects(_read(p), self.algorithm, outside)}
        indexed = [w for w in store.sources() if w[1] not in bare]
        for o in X.pack_objects(_read(part.path), self.algorithm, outside):
            if o["id"] in seen or any(store.has(w, bytes.fromhex(o["id"])) for w in indexed):
                continue
            seen.add(o["id"])
            if self.table == "object_ids":
                yield o["id"], "pack"
            elif self.type in (None, o["type"]):
                yield from self._rows(o["id"], o["type"], len(o["body"]), "pack", o["body"])

    def _rows(self, id_: str, kind: str, size: int, source: str, body: bytes):
        if self.table == "objects":
            yield id_, kind, size, source, body
        elif self.table == "object_ids":
            yield id_, source
        elif self.table == "commits":
            r = X.commit_row(body)
            people = [None if r[k] is None else tuple(r[k].values()) for k in ("author", "committer")]
            yield id_, r["tree_id"], r["parent_ids"], r["parent_count"], *people, r["message"], r["summary"], r["is_signed"], r["merge_tags"]
        elif self.table == "commit_parents":
            yield from ((id_, i, p) for i, p in enumerate(X.commit_row(body)["parent_ids"]))
        elif self.table == "tree_entries":
            yield from ((id_, *row) for row in X.tree_rows(body, X.id_bytes(self.algorithm)))
        else:
            r = X.tag_row(body)
            yield id_, r["object_id"], r["object_type"], r["name"], None if r["tagger"] is None else tuple(r["tagger"].values()), r["message"], r["summary"], r["is_signed"]

    def _reverse_index(self, part):
        """Places in the offset order, from the pack's reverse index or, without one, by sorting."""
        index = PackIndex(part.path.removesuffix(".pack") + ".idx", X.id_bytes(self.algorithm))
        reverse = part.path.removesuffix(".pack") + ".rev"
        order = X.reverse_positions(_read(reverse), index.count) if os.path.exists(reverse) else index.by_offset().tolist()
        for first in range(0, len(order), BATCH):
            places = np.array(order[first : first + BATCH], np.int64)
            yield _batch("reverse_index", os.path.basename(part.path), np.arange(first, first + len(places)), places, _hex(index.every_id()[places]))

    def _pack_types(self, part):
        """Types from the pack's bitmaps alone or, without them, from the heads of its entries."""
        pack = Pack(part.path, self.algorithm)
        order = pack.index.by_offset()
        kinds = np.full(len(order), None, object)
        for kind in ("commit", "tree", "blob", "tag"):
            kinds[[place for place in bitmap_positions(part.path, kind, pack.size) or () if place < len(kinds)]] = kind
        for place in np.flatnonzero(kinds == None).tolist():  # noqa: E711
            kinds[place] = pack.type_of(pack.index.offset_at(int(order[place])))
        for first in range(0, len(order), BATCH):
            own = order[first : first + BATCH]
            yield _batch("pack_types", os.path.basename(part.path), np.arange(first, first + len(own)), _hex(pack.index.every_id()[own]), kinds[first : first + BATCH])

    # ---- single files ----

    def _bundle(self, part):
        b = X.bundle_rows(_read(part.path))
        name = os.path.basename(part.path)
        yield from ((name, b["version"], "capability", None, k if v == "" else f"{k}={v}") for k, v in b["capabilities"])
        yield from ((name, b["version"], "prerequisite", i, n) for i, n in b["prerequisites"])
        yield from ((name, b["version"], "reference", i, n) for i, n in b["references"])

    def _bundle_objects(self, part):
        for o in X.pack_objects(X.bundle_rows(_read(part.path))["pack"], self.algorithm):
            yield os.path.basename(part.path), o["id"], o["type"], len(o["body"]), o["body"]

    def _packet_lines(self, part):
        yield from ((os.path.basename(part.path), i, x) for i, x in enumerate(X.packet_lines(_read(part.path))))

    def _hash_dump(self, part):
        yield from ((os.path.basename(part.path), k, v) for k, v in X.hash_dump(_read(part.path)).items())

    def _headers(self, part):
        yield from ((os.path.basename(part.path), k, v) for k, v in X.header_rows(_read(part.path).decode("utf-8", "replace")).items())

    def _revision_texts(self, part):
        """Deltas take their base from the file of the revision that they name: texts by that revision and place."""
        folder = os.path.dirname(part.path)

        def base(revision: int, offset: int, length: int) -> bytes:
            return X.representation_at(lambda r: _read(os.path.join(folder, str(r))), revision, offset)

        yield from ((os.path.basename(part.path), i, kind, text) for i, (kind, text) in enumerate(X.revision_file_rows(_read(part.path), base)))

    # ---- the rest ----

    def _refs(self, part):
        seen = set()
        for d, _, names in os.walk(os.path.join(part.path, "refs")):
            for n in sorted(names):
                path = os.path.join(d, n)
                name = os.path.relpath(path, part.path)
                seen.add(name)
                yield self._ref(name, path)
        for n in sorted(os.listdir(part.path)):
            if n.isupper() and not n.endswith("MSG") and os.path.isfile(os.path.join(part.path, n)):
                yield self._ref(n, os.path.join(part.path, n))
        packed = os.path.join(part.path, "packed-refs")
        if os.path.exists(packed):
            for name, id_, peeled in X.packed_ref_rows(_read(packed).decode()):
                if name not in seen:  # a loose file is newer
                    yield name, id_, None, peeled, "packed"

    def _ref(self, name, path):
        text = _read(path).decode("utf-8", "replace").strip()
        return (name, None, text[5:].strip(), None, "file") if text.startswith("ref:") else (name, text.split()[0] if text else None, None, None, "file")

    def _reflog(self, part):
        for n, old, new, who, reason in X.reflog_rows(_read(part.path).decode("utf-8", "replace")):
            yield part.value, n, old, new, None if who is None else tuple(who.values()), reason

    def _config(self, part):
        """Settings in file order, an included file's where it is included; the last setting of a key holds."""
        yield from self._settings(part.path, 0)

    def _settings(self, path: str, depth: int):
        for row in X.config_rows(_read(path).decode("utf-8", "replace")):
            yield row
            for more in X.included([row], self.root, os.path.expanduser("~")):
                more = os.path.join(os.path.dirname(path), more)
                if depth < 10 and os.path.exists(more):
                    yield from self._settings(more, depth + 1)

    def _index_entries(self, part):
        """Entries; a split index's own are laid over those of the shared index beside it."""
        size, data = X.id_bytes(self.algorithm), _read(part.path)
        own = list(X.directory_rows(data, size))
        link = dict(X.directory_extensions(data, size)).get("link")
        if link is not None:
            id_, deleted, replaced = X.split_link(link, size)
            shared = os.path.join(os.path.dirname(part.path), f"sharedindex.{id_}")
            if id_.strip("0") and os.path.exists(shared):
                over = dict(zip(replaced, own, strict=False))
                own = X.merge_split_index(list(X.directory_rows(_read(shared), size)), set(deleted), over, own[len(replaced) :])
        for e in own:
            yield tuple(e.values())

    def _pack_index(self, part):
        path = part.path.removesuffix(".pack") + ".idx"
        index = PackIndex(path, X.id_bytes(self.algorithm))
        ids, offsets, sums = index.every_id(), index.offsets(), index.checksums()
        for first in range(0, index.count, BATCH):
            own = slice(first, first + BATCH)
            yield _batch("pack_index", os.path.basename(path), _hex(ids[own]), offsets[own], [None] * len(ids[own]) if sums is None else sums[own])

    def _commit_graph(self, part):
        for r in X.commit_graph_rows(_read(part.path)):
            yield tuple(r.values())

    def _commit_graph_chain(self, part):
        """Layers from the oldest on; a layer's positions count on from those below it."""
        below: list[str] = []
        for name in _read(part.path).decode().split():
            rows = list(X.commit_graph_rows(_read(os.path.join(os.path.dirname(part.path), f"graph-{name}.graph")), below))
            yield from (tuple(r.values()) for r in rows)
            below += [r["id"] for r in rows]

    def _multi_pack_index(self, part):
        yield from X.multi_pack_rows(_read(part.path))


def object_count(spark, path: str, algorithm: str = "sha1") -> int:
    """Number of objects, from names and indexes alone."""
    return load(spark, path, "object_ids", algorithm).count()


def load(spark, path: str, table: str, algorithm: str = "sha1"):
    """A table of the repository at ``path``."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses readers that take filters otherwise
    return spark.read.format("repository").option("table", table).option("algorithm", algorithm).load(path)


# ---- views over the tables ----


def visible_refs(refs):
    """References without the stash."""
    return refs.filter("name != 'refs/stash'")


def branches(refs):
    return refs.filter("name LIKE 'refs/heads/%'")


def tags(refs, tag_objects):
    """Lightweight and annotated tags: name, object the reference holds, object it stands for, and the annotation."""
    from pyspark.sql import functions as F

    t = tag_objects.select(F.col("id").alias("tag_id"), F.col("object_id"), "message", "tagger")
    own = refs.filter("name LIKE 'refs/tags/%'")
    return own.join(t, F.col("id") == F.col("tag_id"), "left").select("name", "id", F.coalesce("object_id", "peeled_id", "id").alias("object_id"), "message", "tagger")


def stashes(reflog):
    """Entries of the stash, latest first by ``position``."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    own = reflog.filter("ref_name = 'refs/stash'")
    return own.select("*", (F.row_number().over(Window.partitionBy("ref_name").orderBy(F.desc("seq"))) - 1).cast("long").alias("position"))


def settings(config):
    """The setting that holds of each key, by the order of the rows within the file."""
    from pyspark.sql import functions as F

    numbered = config.withColumn("n", F.monotonically_increasing_id())  # one partition: the file
    return numbered.groupBy("group", "subgroup", "key").agg(F.max_by(F.struct("value"), "n").alias("v")).select("group", "subgroup", "key", F.col("v.value").alias("value"))


def remotes(config):
    from pyspark.sql import functions as F

    own = settings(config).filter("`group` = 'remote' AND subgroup IS NOT NULL")
    return own.groupBy(F.col("subgroup").alias("name")).agg(F.max(F.when(F.col("key") == "url", F.col("value"))).alias("url"))
