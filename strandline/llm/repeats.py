"""Exact removal of long repeats by common-prefix interval trees of suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else in the corpus is removed.  The suffixes are dealt by content: of the
151 50-byte grams in a 200-byte window the one with the least hash is its
anchor, so equal windows have equal anchors at equal places, and an anchor's
occurrences carry all that must be compared with each other.

1. Anchors are counted in partial sums; one that occurs once has no repeat and
   does not travel again: a bitmap of fixed size holds those that occur twice.
2. An anchor whose occurrences all have the same surroundings repeats in all
   of its windows.
3. The rest are compared byte by byte: the distinct surroundings of an anchor
   meet in one task, in an enhanced suffix array.  A stack scan of its common
   prefixes yields the interval tree; intervals whose suffixes are preceded by
   different bytes are the maximal repeat groups, with all occurrences.
4. An anchor with more distinct surroundings than ``MOST_CONTEXTS`` is not
   gathered: its windows are counted by digest, in partial sums, for all rows.

Equal surroundings, windows (4.) and texts are told by 128 bits of BLAKE2b and
SHA-256 digests of all their bytes; the quick hashes of grams only say what to
compare.  Texts are read in blocks of BLOCK window starts.

Defined results: null and empty texts have no bytes; texts shorter than
``length`` keep all of them; matches never cross documents; equal texts, also
under one doc_id, are repeats of each other; columns other than doc_id and text
are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, discard, materialize, mix64, release, shuffle_partitions, slices, table, trim, utf8_buffer

LENGTH, GRAM = 200, 50
MOST_CONTEXTS = 4096
SLICE_BYTES = 1 << 20
#: Window starts of a text that are read at a time.
BLOCK = 1 << 22
#: Bits of the bitmap of anchors that occur more than once (8 MB).
BITMAP = 1 << 26


# ---- anchors -------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """The anchors of the documents of one buffer, and the windows each of them owns."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.hash = SpanHash(data)
        sizes = np.diff(offsets)
        grams = self.hash.windows(gram)
        at = np.zeros(0, np.int64)
        if len(data) >= length:
            order = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals
            least = (sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            many = np.maximum(sizes - length + 1, 0)
            begin = np.cumsum(many) - many
            windows = np.arange(many.sum()) + np.repeat(offsets[:-1] - begin, many)
            doc = np.repeat(np.arange(len(sizes)), many)
            own = least[windows]
            new = np.ones(len(windows), bool)
            new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
        if not len(at):
            self.doc = self.pos = self.low = self.count = at
            self.gram = np.zeros(0, np.uint64)
            return
        self.doc, self.pos, self.low = doc[at], own[at], windows[at]
        self.count = np.diff(np.append(at, len(windows)))
        self.gram = grams[self.pos]


def pack(low, count, offset):
    """Start in the document, number of windows and place of the anchor in one long."""
    return low << 16 | count << 8 | offset


def text_blocks(batch):
    """(row, bytes, offsets, start) of an Arrow slice's texts: together or, where one is long, block by block."""
    data, offsets = utf8_buffer(batch.column(batch.schema.get_field_index("text")))
    if len(data) <= BLOCK + LENGTH:
        yield np.arange(batch.num_rows), data, offsets, 0
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(b - LENGTH + 1, a + 1), BLOCK):
            part = data[at : min(b, at + BLOCK + LENGTH - 1)]
            yield np.array([row]), part, np.array([0, len(part)]), at - a


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(text) -> the anchors that occur more than once."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", SLICE_BYTES):
            for _, data, offsets, _ in text_blocks(batch):
                a = Anchors(data, offsets)
                if len(a.pos):
                    yield pa.RecordBatch.from_arrays([pa.array(a.gram.view(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")


def bitmap_of(anchors_: DataFrame) -> np.ndarray:
    """A bit for each anchor; others may share it."""
    place = F.pmod("anchor", F.lit(BITMAP))
    words = anchors_.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(anchor, {BITMAP}) & 63 as int))")).alias("bits"))
    out = np.zeros(BITMAP >> 6, np.int64)
    got = words.toArrow()  # BITMAP / 64 rows at most, whatever the corpus holds
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


ANCHOR = "anchor long, around binary, key binary, place long"


def digest_of(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def anchors(docs: DataFrame, bitmap=None) -> DataFrame:
    """(text) -> a row for each anchor that is in the bitmap (a broadcast); ``around`` is the digest of the bytes of its windows
    and its place in them, ``key`` the text's."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", SLICE_BYTES):
            keys: dict[int, bytes] = {}
            texts = batch.column(batch.schema.get_field_index("text"))
            for rows, data, offsets, start in text_blocks(batch):
                a = Anchors(data, offsets)
                some = np.arange(len(a.pos))
                if bitmap is not None:
                    bit = a.gram.view(np.int64) & (BITMAP - 1)
                    some = np.flatnonzero(bitmap.value[bit >> 6] >> (bit & 63) & 1)
                if not len(some):
                    continue
                doc, low, count = a.doc[some], a.low[some], a.count[some]
                offset = a.pos[some] - low
                view = memoryview(np.ascontiguousarray(data))
                around = [hashlib.blake2b(view[x : x + n + LENGTH - 1], digest_size=16, salt=bytes([o])).digest() for x, n, o in zip(low.tolist(), count.tolist(), offset.tolist(), strict=True)]
                own = rows[doc]
                for r in np.unique(own).tolist():
                    if r not in keys:
                        keys[r] = hashlib.sha256(texts[r].as_py().encode()).digest()[:16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.gram[some].view(np.int64)), pa.array(around, pa.binary()), pa.array([keys[r] for r in own.tolist()], pa.binary()), pa.array(pack(low - offsets[doc] + start, count, offset))],
                    names=["anchor", "around", "key", "place"],
                )

    return docs.select("text").mapInArrow(run, ANCHOR)


# ---- suffix array ----------------------------------------------------------------


def rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_ = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
    return out


class SuffixArray:
    """Order and common prefixes of the given suffixes of a sequence of symbols (0 to 256).

    ``most`` is a bound of the common prefixes that matter; order and lengths are exact up to there.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, most: int):
        self.symbols = np.concatenate([symbols, np.zeros(8, symbols.dtype)]).astype(np.int64)
        n = len(symbols)
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | self.symbols[k : n + k]
        self.levels = [(7, rank(key))]
        while self.levels[-1][0] < most:
            size, r = self.levels[-1]
            further = np.full(n, -1, np.int64)
            further[: max(0, n - size)] = r[size:]
            self.levels.append((2 * size, rank(r * (n + 1) + further + 1)))
        last = self.levels[-1][1]
        self.order = starts[np.argsort(last[starts], kind="stable")]
        self.common = self._common(self.order[:-1], self.order[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a[i] and b[i]."""
        n = len(self.symbols) - 8
        out = np.zeros(len(a), np.int64)
        for size, r in reversed(self.levels):
            x, y = a + out, b + out
            inside = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[inside] = r[x[inside]] == r[y[inside]]
            out[same] += size
        for _ in range(6):
            x, y = a + out, b + out
            open_ = np.flatnonzero((x < n) & (y < n))
            more = open_[self.symbols[x[open_]] == self.symbols[y[open_]]]
            if not len(more):
                break
            out[more] += 1
        return out


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int):
    """Yield (length, first, last): intervals of the suffix order whose suffixes share a prefix that no byte before all of them extends.

    ``before`` is the symbol before each suffix, -1 where there is none (which
    differs from all others).  The stack holds the open intervals of the tree.
    """
    for run_from, run_to in _runs(common >= least):
        stack: list[list[int]] = []  # [length, first, symbol before all members or -2]
        for k in range(run_from, run_to + 1):
            lcp = int(common[k]) if k < run_to else least - 1
            first, sym = k, int(before[k])
            sym = -2 if sym == -1 else sym
            while stack and stack[-1][0] > lcp:
                length, begin, held = stack.pop()
                held = held if held == sym else -2
                if held == -2:
                    yield length, begin, k
                first, sym = begin, held
            if lcp >= least:
                if stack and stack[-1][0] == lcp:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == sym else -2
                else:
                    stack.append([lcp, first, sym])


def _runs(mask: np.ndarray):
    """(first, end) of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)


def repeated_windows(contexts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first ``counts[i]`` windows equal another window of the contexts.

    Contexts none of whose windows shares a hash with another cannot have such
    windows; the rest go into the suffix array, which compares bytes.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(sizes) - sizes
    n = np.array(counts)
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    starts = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    h = SpanHash(data).spans(starts, starts + length)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    some = np.flatnonzero(np.add.reduceat(twice, np.cumsum(n) - n) > 0)
    out = [np.zeros(k, bool) for k in counts]
    if len(some):
        for i, mask in zip(some.tolist(), _compared([contexts[i] for i in some.tolist()], [counts[i] for i in some.tolist()], length), strict=True):
            out[i] = mask
    return out


def _compared(contexts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    sizes = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16)
    symbols += 1
    symbols[begin + sizes - 1] = 0
    n = np.array(counts)
    starts = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    suffixes = SuffixArray(symbols, starts, int(sizes.max()))
    end = np.repeat(begin + sizes - 1, n)
    last = np.zeros(len(symbols), np.int64)
    last[starts] = end
    before = np.where(np.isin(suffixes.order, begin), -1, symbols[np.maximum(suffixes.order - 1, 0)])
    longest = np.zeros(len(starts), np.int64)
    for size, first, to in maximal_repeats(suffixes.order, suffixes.common, before, length):
        part = longest[first : to + 1]
        part[part == 0] = size
    hit = np.zeros(len(symbols) + 1, np.int64)
    some = longest > 0
    at = suffixes.order[some]
    np.add.at(hit, at, 1)
    np.add.at(hit, np.minimum(at + longest[some], last[at]) - length + 1, -1)
    covered = np.cumsum(hit) > 0
    return [covered[b : b + k] for b, k in zip(begin.tolist(), counts, strict=True)]


# ---- the operator ------------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def texts_by_key(docs: DataFrame) -> DataFrame:
    """key, text, copies: each distinct text once; copies are dropped before the shuffle where they meet."""
    return docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _ranges(mask: np.ndarray, low: int) -> list[tuple[int, int]]:
    return [(low + a, low + b - 1) for a, b in _runs(mask)]


def _split(place: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(place, 16), F.shiftright(place, 8).bitwiseAND(255), place.bitwiseAND(255)


CONTEXT = "anchor long, around binary, key binary, place long, n long, context binary"
MARK = "key binary, first long, last long"


def _mark_full(rows: DataFrame) -> DataFrame:
    low, count, _ = _split(F.col("place"))
    return rows.select("key", low.alias("first"), (low + count - 1).alias("last"))


def contexts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Add to (anchor, around, key, place, n) the bytes of the owned windows."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "around", "place", "n")).alias("w"))  # at most a text's anchors
    rows = texts_by_key(docs).join(lists, "key").select("key", "text", "w")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for key, text, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                for x in w:
                    low, count = x["place"] >> 16, x["place"] >> 8 & 255
                    out.append((x["anchor"], x["around"], key, x["place"], x["n"], raw[low : low + count + LENGTH - 1]))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "around", "key", "place", "n", "context"])

    return rows.mapInArrow(run, CONTEXT)


def compare_contexts(batches):
    """Marks of the contexts of each anchor that occur once themselves; an anchor's rows follow each other."""
    import pyarrow as pa

    def solve(rows):
        got = repeated_windows(rows.column("context").to_pylist(), [p >> 8 & 255 for p in rows.column("place").to_pylist()])
        out = []
        for key, place, n, mask in zip(rows.column("key").to_pylist(), rows.column("place").to_pylist(), rows.column("n").to_pylist(), got, strict=True):
            if n == 1:
                out += [(key, a, b) for a, b in _ranges(mask, place >> 16)]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "first", "last"])

    pending = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        pending = rows if pending is None else pa.concat_tables([pending, rows])
        while pending.num_rows:
            anchor = pending.column("anchor").to_numpy()
            size = np.cumsum([len(c) for c in pending.column("context").to_pylist()])
            ends = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], False)) + 1  # the last group may go on
            fit = ends[size[ends - 1] <= SLICE_BYTES]
            if size[-1] <= SLICE_BYTES or not len(ends):
                break
            cut = int(fit[-1]) if len(fit) else int(ends[0])
            yield solve(pending.slice(0, cut))
            pending = pending.slice(cut)
    if pending is not None and pending.num_rows:
        yield solve(pending)
    trim()


def count_windows(big: DataFrame) -> DataFrame:
    """Marks of anchors with very many contexts: their windows are counted by digest."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, anchor, place, n, context in zip(*(batch.column(c).to_pylist() for c in ("key", "anchor", "place", "n", "context")), strict=True):
                count, offset = place >> 8 & 255, place & 255
                h = [digest_of(context[i : i + LENGTH]) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * count), pa.array(offset - np.arange(count)), pa.array(h, pa.binary()), pa.array([key] * count, pa.binary()), pa.array((place >> 16) + np.arange(count)), pa.array([n] * count)],
                    names=["anchor", "offset", "h", "key", "first", "n"],
                )

    rows = materialize(big.mapInArrow(run, "anchor long, offset long, h binary, key binary, first long, n long"), "rep-windows")
    often = rows.groupBy("anchor", "offset", "h").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all")
    return rows.filter("n = 1").join(often, ["anchor", "offset", "h"], "left_semi").select("key", "first", F.col("first").alias("last"))


def marks(docs: DataFrame) -> DataFrame:
    """key, first, last: ranges of starts of repeated windows in the texts that have no copy of themselves."""
    spark = docs.sparkSession
    twice = materialize(anchor_counts(docs), "rep-anchors", thin=True)
    release(spark)
    bitmap = spark.sparkContext.broadcast(bitmap_of(twice))
    found = materialize(anchors(docs, bitmap).join(twice, "anchor", "left_semi"), "rep-found")
    discard(twice)
    release(spark)
    mixed = found.groupBy("anchor").agg(F.min("around").alias("lo"), F.max("around").alias("hi")).filter("lo != hi").select("anchor")
    mixed = materialize(mixed, "rep-mixed", thin=True)
    differ = found.join(mixed, "anchor", "left_semi").groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("r"))
    differ = materialize(differ.select("anchor", "around", "n", "r.key", "r.place"), "rep-differ", thin=True)
    big = materialize(differ.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > MOST_CONTEXTS).select("anchor"), "rep-big", thin=True)
    around = materialize(contexts(differ, docs), "rep-contexts")
    release(spark)
    small = around.join(big, "anchor", "left_anti").repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor")
    compared = materialize(small.mapInArrow(compare_contexts, MARK), "rep-compared")
    counted = materialize(count_windows(around.join(big, "anchor", "left_semi")), "rep-counted")
    discard(around)
    same = found.join(mixed, "anchor", "left_anti")
    often = found.join(differ.filter("n > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
    often = often.join(mixed, "anchor", "left_semi")
    return _mark_full(same).unionByName(_mark_full(often)).unionByName(compared).unionByName(counted)


OUT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_spans(n: int, ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given ranges."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        end = min(n, last + length)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """key, text, copies, ranges for each distinct text: all windows of a text that has copies repeat."""
    texts = texts_by_key(docs)
    ranges = marks(docs).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return texts.join(materialize(ranges, "rep-ranges", thin=True), "key", "left")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            out = []
            for key, text, copies, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode()
                if copies > 1:
                    spans = [(0, len(raw))] if len(raw) >= LENGTH else []
                else:
                    spans = removed_spans(len(raw), [(r["first"], r["last"]) for r in ranges or ()])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((key, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    by_key = materialize(with_spans(docs).select("key", "text", "copies", "ranges").mapInArrow(run, OUT), "rep-digest")
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return own.join(by_key, "key").drop("key")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
