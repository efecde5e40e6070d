"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at time j it stands on a character c and
moves on when bit r(j, c) is one.  Walks over two texts that differ by few
edits fall into step again soon after each edit, so edit distance becomes
Hamming distance between what the walks see at each time.  A fingerprint
samples that sequence: sampler m looks at the time with the least hash among
the first 2n (n characters), which moves rarely as n changes, and keeps eight
bits of the characters seen there.  The likeness of two fingerprints is the
share of samplers that agree.

Near pairs come from bands of sampled values and are verified by likeness.

Defined results: a null text is empty; equal texts have equal fingerprints;
rows of one doc_id are ordered by text; null ids come last in descending
order; the only document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import add_columns, materialize, mix64, shuffle_partitions, slices, table
from .components import components, joins

SAMPLES = 128
CLASSES, PERIOD = 64, 8192
SEED = 20240229
#: Below so many active texts a plain loop beats array steps.
FEW = 40
BATCH_CHARS = 2 << 20
#: Classes of a bucket that one task compares.
BUCKET = 2048
MAX_BUCKETS = 4096
#: Rows by which the runs are cut, and characters of their texts.
CUT_SAMPLE, CUT_CHARS = 20_000, 64


def _walk_table() -> np.ndarray:
    """steps[c * PERIOD + j % PERIOD]: how long the walk stays on class c from time j on."""
    bits = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.empty((CLASSES, PERIOD), np.int32)
    gap = np.zeros(CLASSES, np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        gap = np.where(bits[:, j % PERIOD] == 1, 1, gap + 1)
        out[:, j % PERIOD] = gap
    return out.ravel()


def _records() -> list[np.ndarray]:
    """For each sampler the times that hold the least hash so far, up to 2**40.

    The records of a sequence of independent uniform hashes are drawn directly:
    after a record of value v the next comes a geometric time later.
    """
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    out = []
    for _ in range(SAMPLES):
        at, v, times = 0, rng.random(), []
        while at < 1 << 40:
            times.append(at)
            at += int(np.log(1 - rng.random()) / np.log1p(-v)) + 1
            v *= rng.random()
        out.append(np.array(times, np.int64))
    return out


_tables: dict[str, object] = {}


def tables() -> tuple[np.ndarray, list[np.ndarray]]:
    if not _tables:
        _tables["steps"], _tables["records"] = _walk_table(), _records()
    return _tables["steps"], _tables["records"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(classes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Time at which the walk reaches each character of each text; all texts advance together."""
    steps, _ = tables()
    times = np.zeros(len(classes), np.int64)
    order = np.argsort(-size, kind="stable")
    start, left = first[order], size[order]
    j = np.zeros(len(order), np.int64)
    active, i = int(np.searchsorted(-left, 0, side="left")), 0
    while active >= FEW:
        at = start[:active] + i
        now = j[:active]
        times[at] = now
        now += steps[classes[at] * PERIOD + (now & (PERIOD - 1))]
        i += 1
        active = int(np.searchsorted(-left[:active], -i, side="left"))
    rows = None
    for k in range(active):
        rows = rows or steps.reshape(CLASSES, PERIOD).tolist()
        t, seen = int(j[k]), []
        for c in classes[start[k] + i : start[k] + left[k]].tolist():
            seen.append(t)
            t += rows[c][t & (PERIOD - 1)]
        times[start[k] + i : start[k] + left[k]] = seen
    return times


def fingerprints(texts: list[str]) -> np.ndarray:
    """SAMPLES bytes for each text."""
    points = [code_points(t) for t in texts]
    size = np.array([len(p) for p in points], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64)
    flat = np.concatenate([*points, np.zeros(4, np.uint32)]).astype(np.uint64)
    spread = mix64(flat + np.uint64(SEED))
    times = walk((spread[: len(flat) - 4] >> np.uint64(58)).astype(np.int64), first, size)
    _, records = tables()
    # each sampler's time for each text's length
    at = np.empty((len(texts), SAMPLES), np.int64)
    for m, r in enumerate(records):
        at[:, m] = r[np.maximum(np.searchsorted(r, np.maximum(2 * size, 1), side="left") - 1, 0)]
    char = np.empty_like(at)
    for k, (f, n) in enumerate(zip(first, size, strict=True)):
        char[k] = np.searchsorted(times[f : f + n], at[k], side="right") - 1 if n else 0
    # four characters from there on; past a text's end they are zero
    seen = np.zeros(at.shape, np.uint64)
    for d in range(4):
        inside = char + d < size[:, None]
        value = np.where(inside, spread[np.minimum(first[:, None] + char + d, len(spread) - 1)], np.uint64(0))
        seen = seen * np.uint64(0x9E3779B97F4A7C15) + value
    return (mix64(seen + np.arange(SAMPLES, dtype=np.uint64)[None, :]) >> np.uint64(56)).astype(np.uint8)


def fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the hexadecimal fingerprint of its text."""
    schema = T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", BATCH_CHARS):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield add_columns(batch, {name: pa.array([f.tobytes().hex() for f in fingerprints(texts)], pa.string())})

    return docs.mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Share of samplers on which two fingerprint columns agree."""
    pairs = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.filter(pairs, lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2)))
    return F.size(same) / F.lit(float(SAMPLES))


def bands(at_least: float) -> list[tuple[int, int]]:
    """(first sampler, number) of bands of which two fingerprints of that likeness agree in one at least: one more than samplers may differ."""
    n = SAMPLES - math.ceil(at_least * SAMPLES - 1e-9) + 1
    edges = [SAMPLES * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_links(prints: np.ndarray, at_least: float) -> list[tuple[int, int]]:
    """Verified pairs of a bucket that join its rows to the components that all alike pairs would; rows are compared in blocks."""
    n = len(prints)
    top = np.arange(n)
    out = []
    for k in range(0, n, 128):
        like = (prints[k : k + 128, None] == prints[None]).mean(axis=2)
        x, y = np.nonzero(like >= at_least)
        x += k
        taken, top = joins(top, x, y)
        out += list(zip(x[taken].tolist(), y[taken].tolist(), strict=True))
    return out


def near_components(prints: DataFrame, at_least: float = 0.8, most: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, ...) -> doc_id, fingerprint, class_id, component_id.

    A class is the documents of one fingerprint, a component what is linked by likenesses of ``at_least`` or more; both
    are named by their least doc_id.  Alike fingerprints agree in a whole band, so each bucket of a band is compared in
    full, in one task where it has ``most`` classes or fewer.  The classes of a larger one are first compared with its
    least; where several components are left, blocks of it are compared two by two.  No pair is lost.  Null
    fingerprints are linked with nothing.
    """
    classes = materialize(prints.filter("fingerprint IS NOT NULL").groupBy(F.unhex("fingerprint").alias("cls")).agg(F.min("doc_id").alias("doc_id")), "near-classes")
    keys = F.array(*[F.concat(F.lit(bytearray([i])), F.substring("cls", a + 1, n)) for i, (a, n) in enumerate(bands(at_least))])
    rows = materialize(classes.select("cls", F.explode(keys).alias("bucket")), "near-rows")
    sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first")).filter("n > 1"), "near-sizes", thin=True)

    def compare(bucket):
        import pyarrow as pa

        cls = sorted(bucket.column("cls").to_pylist())
        links = bucket_links(np.frombuffer(b"".join(cls), np.uint8).reshape(len(cls), SAMPLES), at_least)
        return pa.table({"a": pa.array([cls[i] for i, _ in links], pa.binary()), "b": pa.array([cls[j] for _, j in links], pa.binary())})

    def verify(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SAMPLES) for i in (0, 1))
            yield batch.take(np.flatnonzero((x == y).mean(axis=1) >= at_least))

    small = rows.join(sizes.filter(F.col("n") <= most).select("bucket"), "bucket", "left_semi")
    links = materialize(small.groupBy("bucket").applyInArrow(compare, "a binary, b binary").distinct(), "near-links", thin=True)
    large = rows.join(sizes.filter(F.col("n") > most), "bucket")
    stars = large.filter("cls != first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    links = links.unionByName(materialize(stars.mapInArrow(verify, "a binary, b binary"), "near-links", thin=True))
    labels = materialize(components(links), "near-labels", thin=True)
    named = large.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = materialize(named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket"), "near-several", thin=True)
    if not several.isEmpty():
        blocks = F.ceil(F.col("n") / most).cast("int")
        dealt = large.join(several, "bucket", "left_semi").select("bucket", "cls", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("own"))
        pairs = dealt.select("bucket", "cls", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = pairs.select("bucket", "cls", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        links = links.unionByName(materialize(pairs.groupBy("bucket", "p", "q").applyInArrow(compare, "a binary, b binary").distinct(), "near-links", thin=True))
        labels = materialize(components(links), "near-labels", thin=True)
    own = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = materialize(own.join(least, "label").select(F.lower(F.hex("cls")).alias("fingerprint"), F.col("doc_id").alias("class_id"), "component_id"), "near-named", thin=True)
    return prints.select("doc_id", F.lower("fingerprint").alias("fingerprint")).join(named, "fingerprint", "left").select("doc_id", "fingerprint", "class_id", "component_id")


def cuts(docs: DataFrame, n: int) -> list:
    """n - 1 rows (doc_id, text prefix) at most that cut the documents, in their order, into runs of about one size."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, CUT_CHARS)
    hashed = docs.select("doc_id", head.alias("head"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    total = docs.count()
    # a bounded sample by hash, so that a rerun cuts at the same places
    few = hashed.filter(F.col("h") < int((1 << 30) * min(1.0, CUT_SAMPLE / max(total, 1)))).distinct().drop("h").collect()
    few.sort(key=lambda r: r["head"])
    few = sorted((r for r in few if r["doc_id"] is not None), key=lambda r: r["doc_id"], reverse=True) + [r for r in few if r["doc_id"] is None]
    at = sorted({len(few) * i // n for i in range(1, n)} - {0})
    return [few[i] for i in at if i < len(few)]


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in runs of descending doc_id, each ended by a row (last = true) that holds the next run's first document.

    Runs are ranges of ids and, within an id or without one, of texts, so no task sees more than its range; the text moves once.
    """
    spark = docs.sparkSession
    n = min(MAX_BUCKETS, shuffle_partitions(spark))
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text"), F.lit(""))
    bounds = F.array(*[F.struct(F.lit(r["doc_id"]).cast(kind).alias("id"), F.lit(r["head"]).alias("head")) for r in cuts(docs, n)]).cast(f"array<struct<id:{kind.simpleString()},head:string>>")

    def before(c: Column) -> Column:
        """Whether a row does not come before the cut c."""
        same = c["id"].eqNullSafe(F.col("doc_id")) & (c["head"] <= text)
        return same | F.coalesce(c["id"] > F.col("doc_id"), c["id"].isNotNull() & F.col("doc_id").isNull())

    rows = docs.select("doc_id", "text", F.size(F.filter(bounds, before)).alias("bucket"))
    # one short row a run reaches the driver: as many as there are partitions
    top = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted(((r["bucket"], r["head"]) for r in top), key=lambda x: x[0])
    if not heads:
        return rows.withColumn("last", F.lit(False))
    before_ = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    ids = F.create_map(*[x for b, h in heads for x in (F.lit(b), F.lit(h).cast(kind))])
    # the first document of each run: the least text of its greatest id
    first = rows.filter(F.col("doc_id").eqNullSafe(ids[F.col("bucket")])).groupBy("bucket").agg(F.min(text).alias("text"))
    to = F.element_at(F.create_map(*[F.lit(x) for kv in before_.items() for x in kv]), F.col("bucket"))
    ends = first.select(F.lit(None).cast(kind).alias("doc_id"), "text", to.alias("bucket"), F.lit(True).alias("last"))
    every = rows.withColumn("last", F.lit(False)).unionByName(ends)
    return every.repartition(n, "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").desc_nulls_last(), text)


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the successor's beginning, and how alike they are."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(OUT).fields])
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def rows(batches):
        for batch in slices(batches, "text", 1 << 20):
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    def emit(ids: list, texts: list[str]):
        """All texts but the last, which is the successor of the one before."""
        import pyarrow as pa

        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
        own, other = fingerprints(texts), fingerprints(edited)
        cols = [
            [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [f.tobytes().hex() for f in own[:-1]], [f.tobytes().hex() for f in other],
            (own[:-1] == other).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1),
        ]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, cols, kinds)], names=schema.names)

    def run(batches):
        ids, texts, size = [], [], 0
        for doc_id, text, _, last in rows(batches):
            text = text or ""
            texts.append(text)
            size += len(text)
            if last or size >= BATCH_CHARS:
                if ids:
                    yield emit(ids, texts)
                ids, texts, size = [], [] if last else [text], 0
            if not last:
                ids.append(doc_id)

    return with_successor(docs.select("doc_id", "text")).mapInArrow(run, schema)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
