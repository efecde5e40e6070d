"""Byte functions: slices, searches, hashes, codecs and bitwise operators.

What Spark has built in is a column expression; codecs and byte-wise operators
without a built-in form are Arrow-batched UDFs.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def each(f: Callable, kind: str, *columns: Column) -> Column:
    """Apply a Python function to rows in Arrow batches; a row with a null argument gives null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    if len(columns) == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one(*columns)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return two(*columns)


# ---- slices: absent bytes are null, no bytes are empty ----


def take(b: Column, n: int) -> Column:
    return F.substring(b, 1, n)


def take_exactly(b: Column, n: int) -> Column:
    return F.when(F.length(b) >= n, F.substring(b, 1, n)).otherwise(F.raise_error(F.lit(f"fewer than {n} bytes")))


def skip(b: Column, n: int) -> Column:
    return F.substring(b, n + 1, 0x7FFFFFF0)


def skip_exactly(b: Column, n: int) -> Column:
    return F.when(F.length(b) >= n, skip(b, n)).otherwise(F.raise_error(F.lit(f"fewer than {n} bytes")))


def leave(b: Column, n: int) -> Column:
    """(body, tail): all but the last n bytes, and those."""
    size = F.greatest(F.length(b) - n, F.lit(0))
    return F.struct(b.substr(F.lit(1), size).alias("body"), b.substr(size + 1, F.lit(n)).alias("tail"))


def until(b: Column, mark: bytes) -> Column:
    """The bytes up to and with the first mark; all if there is none."""
    at = index_of(b, mark)
    return F.when(at >= 0, b.substr(F.lit(1), (at + len(mark)).cast("int"))).otherwise(b)


def index_of(b: Column, mark: bytes) -> Column:
    """0-based place of the first mark, -1 if there is none; found in the spaced hexadecimal form, so only at whole bytes."""
    spaced = F.regexp_replace(F.hex(b), "(..)", "$1 ")
    marked = "".join(f"{x:02X} " for x in mark)
    at = F.instr(spaced, marked)
    return F.when(at > 0, ((at - 1) / 3).cast("int")).otherwise(F.lit(-1))


def starts_with(b: Column, head: bytes) -> Column:
    return F.substring(b, 1, len(head)) == F.lit(bytearray(head))


def ends_with(b: Column, tail: bytes) -> Column:
    return b.substr(F.greatest(F.length(b) - len(tail) + 1, F.lit(1)), F.lit(len(tail))) == F.lit(bytearray(tail))


def same_contents(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def verify_equal(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), a).otherwise(F.raise_error(F.lit("contents differ")))


def split(b: Column, mark: str, limit: int = -1) -> Column:
    """Pieces of ASCII-compatible bytes between marks."""
    return F.transform(F.split(F.decode(b, "ISO-8859-1"), "\\Q" + mark + "\\E", limit), lambda s: F.encode(s, "ISO-8859-1"))


def trim(b: Column) -> Column:
    return F.encode(F.regexp_replace(F.decode(b, "ISO-8859-1"), r"^[\s\x00]+|[\s\x00]+$", ""), "ISO-8859-1")


def _class(members: bytes) -> str:
    return "[" + "".join(f"\\x{x:02X}" for x in members) + "]"


def all_in(b: Column, members: bytes) -> Column:
    """Whether every byte is one of the members."""
    return F.decode(b, "ISO-8859-1").rlike(f"^(?s:{_class(members)})*$(?!\\n)")


def any_in(b: Column, members: bytes) -> Column:
    return F.decode(b, "ISO-8859-1").rlike(_class(members))


def index_of_any(b: Column, members: bytes) -> Column:
    """0-based place of the first byte that is one of the members, -1 if there is none."""
    before = F.length(F.regexp_extract(F.decode(b, "ISO-8859-1"), f"^((?s:(?!{_class(members)}).)*)", 1))
    return F.when(any_in(b, members), before).otherwise(F.lit(-1))


def hex_text(b: Column) -> Column:
    return F.lower(F.hex(b))


# ---- hashes and text encodings ----


def object_header(kind: Column, size: Column) -> Column:
    return F.concat(F.encode(F.concat(kind, F.lit(" "), size.cast("string")), "UTF-8"), F.lit(bytearray(b"\0")))


def object_id(kind: Column, body: Column, sha256: bool = False) -> Column:
    """Content address of a typed body, in hexadecimal."""
    whole = F.concat(object_header(kind, F.length(body)), body)
    return F.sha2(whole, 256) if sha256 else F.sha1(whole)


def hash_with_suffix(b: Column, suffix: Column, bits: int = 256) -> Column:
    return F.sha2(F.concat(b, suffix), bits)


def base64_text(b: Column, wrap: bool = False, padding: bool = True) -> Column:
    """Standard alphabet; ``wrap`` breaks lines of 76 characters with CRLF."""
    flat = F.regexp_replace(F.base64(b), r"[\r\n]", "")
    flat = flat if padding else F.regexp_replace(flat, "=+$", "")
    return F.regexp_replace(flat, "(.{76})(?=.)", "$1\r\n") if wrap else flat


def base64_bytes(text: Column) -> Column:
    flat = F.regexp_replace(text, r"[^A-Za-z0-9+/]", "")
    return F.unbase64(F.concat(flat, F.repeat(F.lit("="), F.pmod(-F.length(flat), F.lit(4)).cast("int"))))


def crc24_of(data: bytes) -> int:
    """CRC-24 of OpenPGP armor (fixed values: polynomial 0x1864CFB, start 0xB704CE)."""
    crc = 0xB704CE
    for byte in data:
        crc = (crc << 8 & 0xFFFFFF) ^ _CRC24[crc >> 16 ^ byte]
    return crc


def _crc24_entry(i: int) -> int:
    c = i << 16
    for _ in range(8):
        c = c << 1 ^ (0x1864CFB if c & 0x800000 else 0)
    return c & 0xFFFFFF


_CRC24 = [_crc24_entry(i) for i in range(256)]


def crc24(b: Column) -> Column:
    return each(crc24_of, "long", b)


def armor_decode(text: str) -> dict | None:
    """Kind, headers and bytes of an ASCII-armored block; null if there is none or its checksum fails."""
    import base64
    import re

    m = re.search(r"-----BEGIN ([A-Z0-9 ]+)-----\r?\n(.*?)-----END \1-----", text, re.S)
    if not m:
        return None
    head, blank, body = m[2].replace("\r", "").partition("\n\n")
    if not blank or not all(re.match(r"[A-Za-z0-9-]+: ", x) for x in head.split("\n") if x):
        head, body = "", m[2]
    rows = [x.strip() for x in body.split("\n") if x.strip()]
    check = rows.pop()[1:] if rows and re.match(r"^=[A-Za-z0-9+/]{4}$", rows[-1]) else None
    try:
        data = base64.b64decode("".join(rows), validate=True)
    except ValueError:
        return None
    if check and int.from_bytes(base64.b64decode(check), "big") != crc24_of(data):
        return None
    return {"kind": m[1], "headers": dict(x.split(": ", 1) for x in head.split("\n") if x), "data": data}


def armor(text: Column) -> Column:
    """(kind, data) of an armored text."""

    @F.pandas_udf("kind string, data binary")
    def run(t: pd.Series) -> pd.DataFrame:
        found = [armor_decode(x or "") or {} for x in t]
        return pd.DataFrame({"kind": [x.get("kind") for x in found], "data": [x.get("data") for x in found]})

    return run(text)


# ---- compression ----


def inflate_any(data: bytes, kind: str) -> bytes:
    return {"gzip": lambda: gzip.decompress(data), "zlib": lambda: zlib.decompress(data), "deflate": lambda: zlib.decompress(data, -15)}[kind]()


def deflate_any(data: bytes, kind: str, level: int = 6) -> bytes:
    if kind == "gzip":
        return gzip.compress(data, level, mtime=0)
    z = zlib.compressobj(level, zlib.DEFLATED, 15 if kind == "zlib" else -15)
    return z.compress(data) + z.flush()


def decompress(b: Column, kind: str = "zlib") -> Column:
    return each(lambda x: inflate_any(x, kind), "binary", b)


#: Levels by name.
LEVELS = {"store": 0, "best_speed": 1, "default": 6, "maximum": 9}


def compress(b: Column, kind: str = "zlib", level: str = "default") -> Column:
    return each(lambda x: deflate_any(x, kind, LEVELS[level]), "binary", b)


def http_dechunk_bytes(data: bytes) -> bytes:
    """Body of a chunked transfer; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_dechunk(b: Column) -> Column:
    return each(http_dechunk_bytes, "binary", b)


def http_chunk(b: Column) -> Column:
    """A body as one chunk and the end mark."""
    size = F.encode(F.lower(F.hex(F.length(b))), "UTF-8")
    crlf = F.lit(bytearray(b"\r\n"))
    return F.when(F.length(b) > 0, F.concat(size, crlf, b, crlf, F.lit(bytearray(b"0\r\n\r\n")))).otherwise(F.lit(bytearray(b"0\r\n\r\n")))


# ---- bitwise operators: the shorter operand is followed by zeros ----

_OPERATORS = {"and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor}


def combine_bytes(a: bytes, b: bytes, operator: str, strict: bool = False) -> bytes:
    if strict and len(a) != len(b):
        raise ValueError("operands differ in length")
    n = max(len(a), len(b))
    x, y = (np.frombuffer(v.ljust(n, b"\0"), np.uint8) for v in (a, b))
    return _OPERATORS[operator](x, y).tobytes()


def bitwise(a: Column, b: Column, operator: str, strict: bool = False) -> Column:
    return each(lambda x, y: combine_bytes(x, y, operator, strict), "binary", a, b)


def bitwise_not(b: Column) -> Column:
    return each(lambda x: (~np.frombuffer(x, np.uint8)).tobytes(), "binary", b)


# ---- numbers ----


def network_int(b: Column, start: int, size: int, signed: bool = False) -> Column:
    """Big-endian integer of ``size`` bytes from a 0-based place."""
    raw = F.conv(F.hex(F.substring(b, start + 1, size)), 16, 10)
    value = raw.cast("decimal(20,0)")
    if signed:
        value = F.when(value >= F.lit(str(1 << (8 * size - 1))).cast("decimal(20,0)"), value - F.lit(str(1 << (8 * size))).cast("decimal(21,0)")).otherwise(value)
        return value.cast("long")
    return value.cast("decimal(20,0)") if size == 8 else value.cast("long")


def size_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Little-endian groups of seven bits, high bit set while more follow; returns value and next place."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def offset_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Big-endian groups of seven bits where each continued group adds one."""
    byte = data[at]
    value, at = byte & 127, at + 1
    while byte & 128:
        byte = data[at]
        value, at = (value + 1) << 7 | byte & 127, at + 1
    return value, at


def plain_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Big-endian groups of seven bits."""
    value = 0
    while True:
        byte = data[at]
        value, at = value << 7 | byte & 127, at + 1
        if byte < 128:
            return value, at


def varint(b: Column, kind: str) -> Column:
    read = {"size": size_varint, "offset": offset_varint, "plain": plain_varint}[kind]

    return each(lambda x: read(x)[0] if x else None, "long", b)


#: 30 bits of generation above 34 bits of time.
MAX_GENERATION, MAX_TIME = 0x3FFFFFFF, 0x3FFFFFFFF


def pack_generation(generation: Column, epoch: Column) -> Column:
    g = F.least(generation.cast("long"), F.lit(MAX_GENERATION).cast("long"))
    t = F.least(epoch.cast("long"), F.lit(MAX_TIME).cast("long"))
    return F.shiftleft(g, 34).bitwiseOR(t)


def unpack_generation(packed: Column) -> Column:
    return F.struct(F.shiftrightunsigned(packed, 34).alias("generation"), packed.bitwiseAND(F.lit(MAX_TIME).cast("long")).alias("epoch"))


def stage_of(flags: Column) -> Column:
    return F.shiftright(flags.bitwiseAND(0x3000), 12)


# ---- text encodings ----

_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def to_text(data: bytes, fallback: str = "latin-1") -> str:
    """Decode by byte order mark, then by zeros that betray UTF-16, then as UTF-8, else by the fallback."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    zeros = data.count(0)
    if zeros > 2 and zeros * 8 > len(data) and len(data) % 2 == 0:
        odd = data[1::2].count(0)
        return data.decode("utf-16-le" if odd * 2 >= zeros else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(fallback, "replace")


def normalize_utf8(b: Column, fallback: str = "latin-1") -> Column:
    return each(lambda x: to_text(x, fallback), "string", b)


def recode(b: Column, source: str, target: str = "utf-8") -> Column:
    return each(lambda x: x.decode(source, "replace").encode(target, "replace"), "binary", b)
