"""TIFF media columns: walk image directories, decode strips and tiles, one row a page.

The reader follows the chain of image file directories of classic TIFF files in
either byte order; it decodes uncompressed, PackBits, LZW and deflate data in
strips or tiles, chunky or planar, and undoes horizontal differencing.  The
writer stores payloads as RGB pages.

Defined results: a null content has no pages; a broken file yields the pages
before the break and one row with a null page and the error; equal contents
have equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, table

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CODECS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
#: Bytes of each TIFF field type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
PAGE_ROWS, STRIP_ROWS = 2048, 256


# ---- codecs --------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += 2 + c
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


CLEAR, END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: most significant bit first, codes widen one entry early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, out, width, have, bits, last = list(base), [], 9, 0, 0, None
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR:
            entries, width, last = list(base), 9, None
            continue
        if last is None:
            word = entries[code]
        else:
            word = entries[code] if code < len(entries) else last + last[:1]
            entries.append(last + word[:1])
            if len(entries) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table_, word = dict(fresh), b""
    put(CLEAR)
    size = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table_:
            word = longer
            continue
        put(table_[word])
        table_[longer] = size
        size += 1
        if size > (1 << width) - 1:
            width += 1
        if size > 4094:
            put(CLEAR)
            table_, size, width = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        put(table_[word])
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    put(END)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def decompress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if codec == LZW:
        return lzw_decode(data)
    if codec == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {codec}")


def compress(data: bytes, codec: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[codec](data)


# ---- reader --------------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPE_CODES:
            continue
        size = TYPE_BYTES[kind] * count
        pos = at + 10 + 12 * i
        if size > 4:
            (pos,) = struct.unpack_from(order + "I", data, pos)
        tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, pos)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _image(data: bytes, tags: dict, order: str) -> tuple[dict, np.ndarray]:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits = one(256), one(257), one(258, 1)
    samples, codec, predictor, planar = one(277, 1), one(259, NONE), one(317, 1), one(284, 1)
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if 324 in tags:
        bw, bh, offsets, counts = one(322), one(323), tags[324], tags[325]
    else:
        bw, bh, offsets, counts = width, min(one(278, height), height), tags[273], tags[279]
    across, down = -(-width // bw), -(-height // bh)
    out = np.zeros((planes, height, width, depth), kind.newbyteorder("=") if bits == 16 else kind)
    for i, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, block = divmod(i, across * down)
        y, x = block // across * bh, block % across * bw
        rows = bh if 324 in tags else min(bh, height - y)
        raw = np.frombuffer(decompress(data[at : at + size], codec), kind, rows * bw * depth).reshape(rows, bw, depth)
        if predictor == 2:
            raw = np.cumsum(raw, axis=1, dtype=out.dtype)
        h, w = min(rows, height - y), min(bw, width - x)
        out[plane, y : y + h, x : x + w] = raw[:h, :w]
    pixels = out[0] if planes == 1 else np.concatenate(list(out), axis=2)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": codec, "photometric": one(262)}, pixels


def pages(data: bytes):
    """Yield (attributes, pixels) for each image directory in order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _image(data, tags, order)


PAGE_SCHEMA = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()),
    T.StructField("photometric", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
])


def decode(media: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, content) -> one row a page: key, page, width, height, ..., pixels, error."""
    schema = T.StructType([media.schema[key], *PAGE_SCHEMA.fields])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, content):
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data = one.column(one.schema.get_field_index(content))[0].as_py()
                if data is None:
                    continue
                rows, n = [], 0
                try:
                    for n, (about, pixels) in enumerate(pages(data)):  # noqa: B007
                        rows.append({"page": n, **about, "pixels": pixels.tobytes(), "error": None})
                except (ValueError, struct.error, zlib.error, IndexError, KeyError, TypeError) as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
                ids = pa.concat_arrays([one.column(one.schema.get_field_index(key))] * len(rows)) if rows else None
                if rows:
                    cols = [pa.array([r.get(f.name) for r in rows], pa.binary() if f.name == "pixels" else pa.string() if f.name == "error" else pa.int32()) for f in PAGE_SCHEMA.fields]
                    yield pa.RecordBatch.from_arrays([ids, *cols], names=schema.names)

    return media.select(key, content).mapInArrow(run, schema)


# ---- writer --------------------------------------------------------------------


def write(images: list[np.ndarray], codec: str = "deflate", predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file with one page for each (height, width, samples) array of 8-bit samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for img in images:
        height, width, samples = img.shape
        bh, bw = tile or (min(strip_rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = img[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = compress(np.ascontiguousarray(block).tobytes(), CODECS[codec])
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        short = lambda *v: (3, v)
        long = lambda *v: (4, v)
        tags = {256: long(width), 257: long(height), 258: short(*[8] * samples), 259: short(CODECS[codec]), 262: short(2 if samples == 3 else 1), 277: short(samples), 284: short(1), 317: short(predictor)}
        tags |= {322: long(bw), 323: long(bh), 324: long(*offsets), 325: long(*counts)} if tile else {273: long(*offsets), 278: long(bh), 279: long(*counts)}
        out += b"\0" * (len(out) % 2)
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                packed, at = struct.pack(order + "I", len(out)), packed
                out += at + b"\0" * (len(at) % 2)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 192 bytes as RGB pages 64 pixels wide."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    return write([img[i : i + PAGE_ROWS] for i in range(0, len(img), PAGE_ROWS)])


def features(pixels: np.ndarray) -> str:
    """Channel means, sample entropy in bits and a 64-bit gradient hash of the pixels."""
    h, w, _ = pixels.shape
    counts = np.bincount(pixels.ravel(), minlength=256)
    p = counts[counts > 0] / pixels.size
    rows = np.linspace(0, h, 9).astype(int)[:-1]
    cols = np.linspace(0, w, 10).astype(int)[:-1]
    flat = pixels.sum(axis=2, dtype=np.int64)
    sums = np.add.reduceat(np.add.reduceat(flat, rows, axis=0), cols, axis=1)
    bits = np.packbits(sums[:, 1:] > sums[:, :-1]).tobytes().hex()
    means = ":".join(f"{m:.3f}" for m in pixels.reshape(-1, pixels.shape[2]).mean(axis=0))
    return f"mean={means};entropy={float(-(p * np.log2(p)).sum()):.4f};gradient={bits}"


OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages long, feature string"


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id and what the stored file gives when it is read back."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(OUT).fields])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                raw = (text or "").encode()
                payload = raw + b" " * (-len(raw) % ROW if raw else ROW)
                media = store(payload)
                decoded = [px for _, px in pages(media)]
                pixels = np.concatenate(decoded)
                back = pixels.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(decoded), features(pixels)))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *arrays], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
