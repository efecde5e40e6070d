"""MinHash near-dedup with an LSH forest.

Documents with equal shingle sets form a class.  Each class gets 128 minimum
hashes, eight for each of 16 trees.  For every tree the classes are sorted by
their eight values, so neighbours share the longest prefixes; classes that
share at least four values are one region.

1. In a small region all pairs whose sketches are alike are candidates.  A
   crowded region is descended, prefix by prefix, and its classes are paired
   with the hubs (those nearest to the consensus) of each depth.
2. Hub pairs are confirmed on full shingle sets first; of the others only those
   between the components found so far are left to confirm.
3. Where a crowded region still holds several components, all its classes meet
   in one task with their own sets (the least BOTTOM hashes of a set; most sets
   are smaller), which replaces the sketch; what joins components is confirmed.
4. A region of more than LARGE classes is not gathered.  Its portions meet
   through the best of their hubs; what is left unlinked is joined exactly, by
   the first shingles of the sets in a common order, without a bound on pairs.

Two classes of similarity 0.8 share four values of a tree with probability
0.41, and of at least one tree with 0.9998.  In small regions their sketches
are too unlike for a confirmation with probability MISS at most, in all trees
alike (``miss=0`` confirms every pair of a small region).

Words are hashed with BLAKE2b, so sets that have equal hashes have equal words.

Defined results: null and empty texts have an empty set, are linked with
nothing and are kept; a null doc_id takes part in links, comes last as a
representative, and is kept where its component has no id; rows that repeat a
doc_id count as copies only if their texts do; columns other than doc_id and
text are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, release, shuffle_partitions, slices, table, trim
from .components import components, joins

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
HASHES = TREES * DEPTH
#: Values of four bits in a sketch, one of each minimum hash.
SKETCH = HASHES
#: Regions of so many classes at most are compared in full at once; larger ones meet HUBS hubs of each depth first.
SMALL, HUBS = 32, 4
#: Regions of so many classes at most meet in one task; of a set so many hashes come along.
LARGE, BOTTOM = 2048, 2048
#: Buckets by which shingles are counted, so that rare ones come first in the order of the exact join.
RARITY = 1 << 16
#: Share of pairs of the least similarity whose sketches may be too unlike for a confirmation.
MISS = 0.00035
#: Rows of a region that a task reads at a time; the rest is a portion of its own.
PORTION = 1 << 16
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(4711))
MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def least_alike(numerator: int, denominator: int, miss: float = MISS) -> float:
    """Share of equal sketch values from which a pair is confirmed; a pair of the least similarity has fewer with probability ``miss`` at most."""
    p = numerator / denominator
    p += (1 - p) / 16  # unequal minima have equal values of four bits by chance
    total, k = 0.0, 0
    while k < SKETCH:
        total += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if total > miss:
            break
        k += 1
    return k / SKETCH


# ---- shingles and signatures -----------------------------------------------------


class WordHashes(dict):
    """Word (bytes) -> 64 bits of its BLAKE2b digest; emptied when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = WordHashes()


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text (runs of bytes other than space and 0x09-0x0D, A-Z in lower case)."""
    if len(raw) <= BLOCK:
        found = raw.lower().split()
        return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    out, at, held = [], 0, b""
    while at < len(raw):
        part = held + raw[at : at + BLOCK]
        at += BLOCK
        held = b""
        if at < len(raw) and not part[-1:].isspace():
            head = part.rsplit(None, 1)
            part, held = (b"", part) if len(head) < 2 else (head[0], head[1])
        found = part.lower().split()
        out.append(np.fromiter(map(_words.__getitem__, found), np.uint64, len(found)))
    return np.concatenate(out)


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    import pyarrow as pa

    texts = column.cast(pa.large_binary()).to_pylist()
    if sum(map(len, filter(None, texts))) <= BLOCK:
        lists = [(t or b"").lower().split() for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        hashes = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum()))
    else:
        parts = [word_hashes(t or b"") for t in texts]
        counts = np.array([len(x) for x in parts], np.int64)
        hashes = np.concatenate(parts)
    first = np.concatenate(([0], np.cumsum(counts)))
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    if n >= words:
        m = n - words + 1
        acc = np.zeros(m, np.uint64)
        for k in range(words):
            acc = mix64(acc * np.uint64(3) + hashes[k : k + m])
        grams[:m] = acc
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    acc = mix64(np.array([acc * np.uint64(3) + h], np.uint64))[0]
            out.append(np.array([acc], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes | None:
    """128-bit key of a set; null for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes of a set, 32 bits each; long sets are taken in blocks."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048, None] * MULTIPLY + ADD
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def packed(sig: np.ndarray, size: int) -> bytes:
    """Two bytes of each value for the trees; the sketch: four bits of each value, two to a byte, and the set's size."""
    spread = mix64(sig.astype(np.uint64))
    four = (spread >> np.uint64(32)).astype(np.uint8) & 15
    return spread.astype(np.uint16).tobytes() + (four[0::2] | four[1::2] << 4).tobytes() + np.uint32(size).tobytes()


SKETCH_BYTES = SKETCH // 2 + 4
SIGNED = "text_key long, n_shingles long, cls binary, sig binary"


def text_key(text: str = "text"):
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, n_shingles, cls, sig."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(SIGNED).fields])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), words)
            arrays = [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([packed(signature(s), len(s)) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=schema.names)

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, schema)


def representatives(signed: DataFrame) -> DataFrame:
    """cls, doc_id, text_key, sig: each class once, with the least doc_id that has one (null comes last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r")
    return signed.filter("cls is not null").groupBy("cls").agg(first, F.max("sig").alias("sig")).select("cls", "r.doc_id", "r.text_key", "sig")


def class_sets(classes: DataFrame, reps: DataFrame, docs: DataFrame, words: int, keep=None, result: str = "shingles binary") -> DataFrame:
    """(cls) -> cls and, of its representative's text, the sorted shingle hashes, or what ``keep`` makes of them."""
    fields = T._parse_datatype_string(f"cls binary, {result}")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), words)
            mine = [(c, s) for c, s in zip(batch.column(0).to_pylist(), sets, strict=True) if set_key(s) == c]
            cols = [[c for c, _ in mine], *zip(*((keep or (lambda s: (s.tobytes(),)))(s) for _, s in mine), strict=True)] if mine else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=False)], names=fields.names)

    chosen = classes.join(reps.select("cls", "doc_id", "text_key"), "cls").alias("c")
    d = docs.select("doc_id", "text", text_key().alias("text_key")).alias("d")
    texts = d.join(chosen, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key"))).select("c.cls", "d.text")
    # rows may repeat a doc_id and its text
    return texts.mapInArrow(run, fields).groupBy("cls").agg(*[F.max(c).alias(c) for c in fields.names[1:]])


# ---- the forest --------------------------------------------------------------------


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _near_size(sizes: np.ndarray, x, y, share: float) -> np.ndarray:
    return np.minimum(sizes[x], sizes[y]) >= share * np.maximum(sizes[x], sizes[y]) - 1e-9


def region_pairs(keys: np.ndarray, sketches: np.ndarray, sizes: np.ndarray | None = None, like: float | None = None, share: float = 0.0) -> list[tuple[int, int, int]]:
    """Candidate pairs (i, j, tier), i < j, of one region: rows that share the first LEAST_DEPTH values, in sort order.

    All alike pairs (tier 2) where the region is small; otherwise the pairs of
    each row with the hub of each depth that it is most alike to, and of hubs (tier 1).
    """
    like = least_alike(8, 10) if like is None else like
    sizes = np.ones(len(keys)) if sizes is None else sizes
    m = len(keys)
    codes: list[np.ndarray] = []

    def add(x, y, tier: int) -> None:
        keep = (x != y) & _near_size(sizes, x, y, share)
        x, y = x[keep], y[keep]
        codes.append((np.minimum(x, y) * m + np.maximum(x, y)) * 4 + tier)

    def star(rows: np.ndarray, own: np.ndarray) -> None:
        heads = hubs(own)
        to = np.stack([_alike(own, own[h]) for h in heads])
        best = to.argmax(axis=0)
        near = np.flatnonzero(to[best, np.arange(len(rows))] >= like)
        add(rows[near], rows[np.array(heads)[best[near]]], 1)
        x, y = np.nonzero(np.triu(to[:, heads] >= like, 1))
        add(rows[np.array(heads)[x]], rows[np.array(heads)[y]], 1)

    def descend(rows: np.ndarray, depth: int) -> None:
        n = len(rows)
        if n < 2:
            return
        own = sketches[rows]
        star(rows, own)
        if n <= SMALL:
            return
        if depth < DEPTH:
            value = keys[rows, depth]
        elif depth < DEPTH + SKETCH:
            # a whole signature in common: go on by the values of the sketch, from another one in each region
            value = own[:, (depth + turn) % SKETCH]
            order = np.argsort(value, kind="stable")
            rows, value = rows[order], value[order]
        else:
            return
        cuts = np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1, [n]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            descend(rows[a:b], depth + 1)

    turn = int(keys[0, 0]) if m else 0
    if 1 < m <= SMALL:
        x, y = np.nonzero(np.triu(_alike(sketches[:, None], sketches[None]) >= like, 1))
        add(x, y, 2)
    else:
        descend(np.arange(m), LEAST_DEPTH)
    if not codes:
        return []
    found = np.unique(np.concatenate(codes))
    pair = found >> 2
    return list(zip((pair // m).tolist(), (pair % m).tolist(), (found & 3).tolist(), strict=True))


def hubs(sketches: np.ndarray) -> list[int]:
    """The rows nearest to the consensus of a region."""
    agree = np.zeros(len(sketches), np.int32)
    for col in sketches.T:
        agree += col == np.bincount(col, minlength=16).argmax()
    return np.argsort(-agree, kind="stable")[:HUBS].tolist()


#: A candidate pair; or one of the hubs (cls, sketch) of a part of a crowded region, the first of which has the part's rows.
FOUND = "a binary, b binary, tier int, tree int, prefix binary, n int, part int, cls binary, sketch binary"


def forest_rows(reps: DataFrame) -> DataFrame:
    """(cls, sig) -> a row for each tree: tree, key, cls, sketch."""
    trees = reps.select("cls", "sig", F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"))
    key = F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    return trees.select("tree", key.alias("key"), "cls", F.expr(f"substring(sig, {2 * HASHES + 1}, {SKETCH_BYTES})").alias("sketch"))


def prefix(sig_or_key: str = "key"):
    return F.expr(f"substring({sig_or_key}, 1, {2 * LEAST_DEPTH})").alias("prefix")


def unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values and the set sizes of sketches."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH_BYTES)
    four = np.empty((len(raw), SKETCH), np.uint8)
    four[:, 0::2], four[:, 1::2] = raw[:, : SKETCH // 2] & 15, raw[:, : SKETCH // 2] >> 4
    return four, np.ascontiguousarray(raw[:, SKETCH // 2 :]).view(np.uint32).ravel().astype(np.int64)


def _found_schema():
    import pyarrow as pa

    b, i = pa.binary(), pa.int32()
    return pa.schema([("a", b), ("b", b), ("tier", i), ("tree", i), ("prefix", b), ("n", i), ("part", i), ("cls", b), ("sketch", b)])


def _pair_batch(pairs: dict[tuple[bytes, bytes], int]):
    import pyarrow as pa

    schema = _found_schema()
    n = len(pairs)
    head = [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int32())]
    return pa.RecordBatch.from_arrays([*head, *[pa.nulls(n, f.type) for f in list(schema)[3:]]], schema=schema)


def _part_batch(tree: int, prefix_: bytes, n: int, hubs_: list[tuple[bytes, bytes]]):
    import pyarrow as pa

    schema = _found_schema()
    k = len(hubs_)
    cols = [[None] * k] * 3 + [[tree] * k, [prefix_] * k, [n] + [0] * (k - 1), [1] + [0] * (k - 1), [c for c, _ in hubs_], [s for _, s in hubs_]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _note(pairs: dict[tuple[bytes, bytes], int], x: bytes, y: bytes, tier: int) -> None:
    key = (x, y) if x < y else (y, x)
    pairs[key] = min(tier, pairs.get(key, tier))


def scan(like: float, share: float):
    """Candidates of the regions of one partition of the sorted forest.

    A region that is crowded, and the partition's first and last one, which may
    go on in its neighbours, are reported by their size and hubs.
    """

    def run(batches):
        import pyarrow as pa

        pairs: dict[tuple[bytes, bytes], int] = {}  # of this partition so far; flushed when it grows
        pending, first = None, True

        def close(region, edge: bool):
            m = region.num_rows
            raw = region.column("key").to_pylist()
            keys = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, DEPTH)
            sketch, cls = region.column("sketch").to_pylist(), region.column("cls").to_pylist()
            sketches, sizes = unpacked(sketch)
            for i, j, tier in region_pairs(keys, sketches, sizes, like, share):
                _note(pairs, cls[i], cls[j], tier)
            if edge or m > SMALL:
                return _part_batch(region.column("tree")[0].as_py(), raw[0][: 2 * LEAST_DEPTH], m, [(cls[h], sketch[h]) for h in hubs(sketches)])
            return None

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if pending is not None:
                rows = pa.concat_tables([pending, rows])
            if not rows.num_rows:
                continue
            tree = rows.column("tree").to_numpy()
            pre = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint16).reshape(-1, DEPTH)[:, :LEAST_DEPTH]
            same = (tree[1:] == tree[:-1]) & (pre[1:] == pre[:-1]).all(axis=1)
            cuts = np.concatenate(([0], np.flatnonzero(~same) + 1)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if first or b - a > 1:
                    part = close(rows.slice(a, b - a), first)
                    first = False
                    if part is not None:
                        yield part
            pending = rows.slice(cuts[-1])
            if pending.num_rows >= PORTION:
                yield close(pending, True)
                pending, first = None, True
            if len(pairs) >= 100_000:
                yield _pair_batch(pairs)
                pairs.clear()
        if pending is not None and pending.num_rows:
            yield close(pending, True)
        if pairs:
            yield _pair_batch(pairs)
        trim()

    return run


def candidates(reps: DataFrame, like: float, share: float) -> tuple[DataFrame, DataFrame]:
    """(cls, sig) of distinct classes -> candidate pairs a < b, each once, and their tier; and the crowded regions: tree, prefix, n.

    Regions in several parts count as crowded, too.
    """
    spark = reps.sparkSession
    rows = forest_rows(reps)
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")
    found = materialize(ordered.mapInArrow(scan(like, share), FOUND), "mh-found")
    parts = found.filter("tree is not null")
    regions = parts.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.sum("part").alias("parts")).filter((F.col("n") > 1) & ((F.col("n") > SMALL) | (F.col("parts") > 1)))
    regions = materialize(regions, "mh-regions", thin=True)
    pairs = found.filter("a is not null").select("a", "b", "tier")
    apart = regions.filter((F.col("n") > LARGE) & (F.col("parts") > 1))
    if not apart.isEmpty():
        pairs = pairs.unionByName(across_parts(parts.join(apart.select("tree", "prefix"), ["tree", "prefix"]), rows, like))
    return pairs.filter("a != b").groupBy("a", "b").agg(F.min("tier").alias("tier")), regions.select("tree", "prefix", "n")


def across_parts(parts: DataFrame, rows: DataFrame, like: float) -> DataFrame:
    """Pairs of the classes of regions in several parts with the best hubs of all parts."""

    def across(region):
        import pyarrow as pa

        region = region.sort_by("cls")
        best = region.take(pa.array(hubs(unpacked(region.column("sketch").to_pylist())[0]), pa.int64()))
        return best.select(["tree", "prefix", "cls", "sketch"])

    def meet(batches):
        for batch in batches:
            own, _ = unpacked(batch.column(1).to_pylist())
            pairs: dict[tuple[bytes, bytes], int] = {}
            for cls, sketch, best in zip(batch.column(0).to_pylist(), own, batch.column(2).to_pylist(), strict=True):
                to = _alike(unpacked([h["sketch"] for h in best])[0], sketch)
                if to.max() >= like and best[to.argmax()]["cls"] != cls:
                    _note(pairs, cls, best[to.argmax()]["cls"], 1)
            yield _pair_batch(pairs)

    # HUBS rows a part, and no more parts than partitions and PORTIONs of rows
    joined = parts.select("tree", "prefix", "cls", "sketch").groupBy("tree", "prefix").applyInArrow(across, "tree int, prefix binary, cls binary, sketch binary")
    best = materialize(joined.groupBy("tree", "prefix").agg(F.collect_list(F.struct("cls", "sketch")).alias("best")), "mh-best", thin=True)
    members = rows.select("tree", prefix(), "cls", "sketch").join(best, ["tree", "prefix"])
    return members.select("cls", "sketch", "best").mapInArrow(meet, FOUND).select("a", "b", "tier")


# ---- confirmation and components -----------------------------------------------------


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs of classes whose full sets have intersection / union >= numerator / denominator; hot classes' rows are split by Spark."""
    x, y = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                same = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(denominator * same >= numerator * (len(u) + len(v) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def labelled(classes: DataFrame, labels: DataFrame, cls: str = "cls", label: str = "label") -> DataFrame:
    """Add the component of each class, which is the class itself where it has no link."""
    own = labels.select(F.col("node").alias(cls), F.col("label").alias(label))
    return classes.join(own, cls, "left").withColumn(label, F.coalesce(label, cls))


def across_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are not yet in one component."""
    out = labelled(labelled(pairs, labels, "a", "a_label"), labels, "b", "b_label")
    return out.filter("a_label != b_label").select("a", "b")


# ---- crowded regions -----------------------------------------------------------------


def bottom(s: np.ndarray) -> tuple[bytes, int]:
    """The BOTTOM least 32-bit hashes of a set, and its size."""
    return np.unique((mix64(s) >> np.uint64(32)).astype(np.uint32))[:BOTTOM].tobytes(), len(s)


def common_counts(lists: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Number of values that each of the given rows shares with every list."""
    m = len(lists)
    value = np.concatenate(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    often = np.diff(np.append(at, len(value)))
    place = np.full(m, -1)
    place[rows] = np.arange(len(rows))
    out = np.zeros((len(rows), m), np.float32)
    hot = np.flatnonzero(often * 10 >= max(m, 20))
    # values that many lists have: a matrix product, some columns at a time; others: list by list
    for k in range(0, len(hot), 1024):
        there = np.zeros((m, min(1024, len(hot) - k)), np.float32)
        for c, v in enumerate(hot[k : k + 1024].tolist()):
            there[owner[at[v] : at[v] + often[v]], c] = 1
        out += there[rows] @ there.T
    flat = out.reshape(-1)
    for size in np.unique(often[(often > 1) & (often * 10 < max(m, 20))]).tolist():
        mine = at[often == size]
        for k in range(0, len(mine), max(1, (1 << 20) // size**2)):
            group = owner[mine[k : k + max(1, (1 << 20) // size**2), None] + np.arange(size)]
            x, y = np.broadcast_to(place[group][:, :, None], (*group.shape, size)).ravel(), np.broadcast_to(group[:, None, :], (*group.shape, size)).ravel()
            code, many = np.unique((x * m + y)[x >= 0], return_counts=True)
            flat[code] += many
    return out


def region_links(lists: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Pairs of a crowded region that join its components: as few as will do of the sure ones, and all that only full sets can decide.

    ``lists`` are the BOTTOM least hashes of the sets (all of a smaller set).
    """
    names, many = np.unique(labels, return_counts=True)
    rows = np.flatnonzero(labels != names[many.argmax()])  # the largest component's classes need not meet each other
    length = np.array([len(x) for x in lists], np.int64)
    cut = sizes > BOTTOM
    last = np.array([int(x[-1]) if c else 1 << 32 for x, c in zip(lists, cut.tolist(), strict=True)])
    # below the lesser of two last values both lists have all that the sets have
    below = np.stack([np.searchsorted(x, last, side="right") for x in lists]) if cut.any() else None  # [j, i]: of j's list, up to i's last
    share = numerator / denominator
    common = common_counts(lists, rows)
    sure, unsure = [], []
    for k in range(0, len(rows), 256):
        x = rows[k : k + 256]
        same = common[k : k + 256].astype(np.int64)
        left, right = length[x, None], length[None]
        whole = ~cut[x, None] & ~cut[None]
        if below is not None:
            left, right = np.minimum(left, below[x]), np.minimum(right, below[:, x].T)
        union = np.maximum(left + right - same, 1)
        # whole lists are exact but for hashes that meet by chance; of others the share is a sample's
        slack = np.where(whole, 1.0, 4 * np.sqrt(share * (1 - share) * union))
        possible = (same + slack >= share * (union - whole) - 1e-9) & (labels[x, None] != labels[None]) & _near_size(sizes, x[:, None], np.arange(len(lists))[None], share)
        certain = possible & (same - slack >= share * (union + whole))
        for out, mask in ((sure, certain), (unsure, possible & ~certain)):
            i, j = np.nonzero(mask)
            out.append((x[i], j))
    x, y = (np.concatenate([p[k] for p in sure] or [np.zeros(0, np.int64)]) for k in (0, 1))
    taken, joined = joins(labels, x, y)
    out = list(zip(x[taken].tolist(), y[taken].tolist(), strict=True))
    for x, y in unsure:
        open_ = joined[x] != joined[y]
        out += zip(x[open_].tolist(), y[open_].tolist(), strict=True)
    return out


def crowded_pairs(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(tree, prefix, cls, label, hashes, n) -> candidate pairs a, b within regions of LARGE classes at most."""

    def run(region):
        import pyarrow as pa

        region = region.sort_by("cls")
        cls = region.column("cls").to_pylist()
        _, labels = np.unique(np.array([x.hex() for x in region.column("label").to_pylist()]), return_inverse=True)
        lists = [np.frombuffer(x, np.uint32) for x in region.column("hashes").to_pylist()]
        found = region_links(lists, region.column("n").to_numpy(), labels, numerator, denominator)
        ends = [sorted((cls[i], cls[j])) for i, j in found]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.binary()), "b": pa.array([y for _, y in ends], pa.binary())})

    return members.groupBy("tree", "prefix").applyInArrow(run, "a binary, b binary").distinct()


def first_shingles(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(cls, shingles) -> cls, n, shingle, rest: of each set of n the shingles of which alike sets have one in common, and how many follow.

    A set of likeness t has t * n of the n shingles at least in common, in
    whatever order; rare ones come first here, by counts of hash buckets.
    """

    def count(batches):
        import pyarrow as pa

        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(x, np.uint64) % np.uint64(RARITY), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(RARITY, np.int64)
    for bucket, n in sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # RARITY rows at most
        counts[bucket] = n
    often = sets.sparkSession.sparkContext.broadcast(counts)

    def firsts(batches):
        import pyarrow as pa

        for batch in batches:
            cls, size, shingle, rest = [], [], [], []
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(x, np.uint64)
                n = len(s)
                k = n + -(numerator * n) // denominator + 1
                s = s[np.lexsort((s, often.value[s % np.uint64(RARITY)]))[:k]]
                cls += [c] * k
                size.append(np.full(k, n, np.int32))
                shingle.append(s.view(np.int64))
                rest.append(n - 1 - np.arange(k, dtype=np.int32))
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), *[pa.array(np.concatenate(v)) for v in (size, shingle, rest)]], names=["cls", "n", "shingle", "rest"])

    return sets.select("cls", "shingles").mapInArrow(firsts, "cls binary, n int, shingle long, rest int")


def first_shingle_pairs(sets: DataFrame, labels: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """All pairs a, b of classes in different components that can be alike by their first common shingle."""
    firsts = materialize(labelled(first_shingles(sets, numerator, denominator), labels), "mh-firsts")
    # of a shingle's classes only those outside its largest component have to meet all others
    by = firsts.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max_by("label", "k").alias("top"), F.count(F.lit(1)).alias("labels"))
    live = materialize(firsts.join(by.filter("labels > 1").select("shingle", "top"), "shingle"), "mh-live")
    x = live.filter("label != top").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "rest", "label")])
    y = live.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("cls", "n", "rest", "label")])
    size = F.least("x_n", "y_n") * denominator >= F.greatest("x_n", "y_n") * numerator
    # the first shingle that two sets share leaves no more than the shorter rest to share
    share = (F.least("x_rest", "y_rest") + 1) * (numerator + denominator) >= (F.col("x_n") + F.col("y_n")) * numerator
    met = x.join(y, "shingle").filter((F.col("x_label") != F.col("y_label")) & size & share)
    return met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def crowded_links(regions: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame | None:
    """All links a, b between the components that crowded regions hold so far; None where each holds one."""
    rows = reps.select("cls", "sig", F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"))
    members = rows.select("tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * LEAST_DEPTH})").alias("prefix"), "cls").join(regions, ["tree", "prefix"])
    members = materialize(labelled(members, labels), "mh-members")
    several = members.groupBy("tree", "prefix").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("tree", "prefix")
    members = materialize(members.join(materialize(several, "mh-several", thin=True), ["tree", "prefix"]), "mh-members")
    pairs = []
    gathered, large = members.filter(F.col("n") <= LARGE), members.filter(F.col("n") > LARGE)
    if not gathered.isEmpty():
        hashes = materialize(class_sets(gathered.select("cls").distinct(), reps, docs, words, bottom, "hashes binary, n long"), "mh-hashes")
        pairs.append(materialize(crowded_pairs(gathered.drop("n").join(hashes, "cls"), numerator, denominator), "mh-gathered", thin=True))
    if not large.isEmpty():
        sets = materialize(class_sets(large.select("cls").distinct(), reps, docs, words), "mh-sets")
        pairs.append(materialize(first_shingle_pairs(sets, labels, numerator, denominator), "mh-met", thin=True))
    if not pairs:
        return None
    pairs = pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1]).distinct()
    sets = materialize(class_sets(classes_of(pairs), reps, docs, words), "mh-sets")
    return confirm(pairs, sets, numerator, denominator)


def near_duplicates(docs: DataFrame, words: int = 5, numerator: int = 8, denominator: int = 10, miss: float = MISS) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, n_shingles, cls, component_id: the least doc_id of a document's component,
    and first: whether a row has that doc_id and the least key of its texts in the component."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, words), "mh-signed")
    reps = materialize(representatives(signed), "mh-reps", thin=True)
    pairs, regions = candidates(reps, least_alike(numerator, denominator, miss), numerator / denominator)
    pairs = materialize(pairs, "mh-pairs", thin=True)
    sets = materialize(class_sets(classes_of(pairs), reps, docs, words), "mh-sets")
    release(spark)
    links = materialize(confirm(pairs.filter("tier = 1"), sets, numerator, denominator), "mh-links", thin=True)
    labels = materialize(components(links), "mh-labels", thin=True)
    rest = across_components(pairs.filter("tier = 2"), labels)
    links = links.unionByName(materialize(confirm(rest, sets, numerator, denominator), "mh-links", thin=True))
    labels = materialize(components(links), "mh-labels", thin=True)
    release(spark)
    if not regions.isEmpty():
        more = crowded_links(regions, labels, reps, docs, words, numerator, denominator)
        if more is not None:
            links = links.unionByName(materialize(more, "mh-links", thin=True))
            labels = materialize(components(links), "mh-labels", thin=True)
            release(spark)
    # nulls come after all ids as a component's least
    own = labelled(reps.select("cls", "doc_id", "text_key"), labels)
    least = own.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r"))
    owners = own.select("cls", "label").join(least, "label").select("cls", F.col("r.doc_id").alias("component_id"), F.col("r.text_key").alias("least_key"))
    found = signed.drop("sig").join(materialize(owners, "mh-owners", thin=True), "cls", "left")
    first = F.col("cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("least_key")))
    return found.select("doc_id", "text_key", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), first.alias("first"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
