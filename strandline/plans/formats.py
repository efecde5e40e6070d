"""Queries of the byte, delta, packet and file formats: rows are written in a format and read back by its decoder."""

from __future__ import annotations

import os
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import crypto as C
from ..functions import diff as D
from ..functions import text as X
from ..operators import signatures as S
from ..sources import packs as P
from ..sources import repository as R
from ..sources import writers as W
from .registry import query
from .repository import local_path
from .tables import load


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _body() -> Column:
    return F.encode("text", "UTF-8")


# ---- bytes: every document, whatever its letters ----


_HEX = "hex(encode(text))"


@query(f"""SELECT doc_id, md5(unhex(substr({_HEX}, 1, 40))) AS head, md5(unhex(substr({_HEX}, 11))) AS rest, md5(unhex(left({_HEX}, greatest(length({_HEX}) - 8, 0)::INT))) AS body,
CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents""")
def byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take, skip and leave count bytes, also within letters of several bytes."""
    b = _body()
    return _docs(spark, sf_dir).select("doc_id", F.md5(B.take(b, 20)).alias("head"), F.md5(B.skip(b, 5)).alias("rest"), F.md5(B.leave(b, 4)["body"]).alias("body"), F.length(b).cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN octet_length(encode(left(text, strpos(text, 'the')::INT - 1)))::BIGINT ELSE -1 END AS at, starts_with(text, 'The') AS the,
ends_with(text, '.') AS stop, md5(encode(CASE WHEN strpos(text, 'e') > 0 THEN left(text, strpos(text, 'e')::INT) ELSE text END)) AS upto FROM documents""")
def byte_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _body()
    return _docs(spark, sf_dir).select("doc_id", B.index_of(b, b"the").cast("long").alias("at"), B.starts_with(b, b"The").alias("the"), B.ends_with(b, b".").alias("stop"), F.md5(B.until(b, b"e")).alias("upto"))


@query("""SELECT p_partkey, left(p_name, 3) AS head, substr(p_name, 4) AS rest, lower(hex(encode(p_name))) AS digits, p_name = p_brand AS same, true AS itself FROM part""")
def byte_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact slices, hexadecimal text and comparison of contents."""
    b = F.encode("p_name", "UTF-8")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.decode(B.take_exactly(b, 3), "UTF-8").alias("head"), F.decode(B.skip_exactly(b, 3), "UTF-8").alias("rest"), B.hex_text(b).alias("digits"),
        B.same_contents(b, F.encode("p_brand", "UTF-8")).alias("same"), (B.verify_equal(b, b) == b).alias("itself"),
    )


@query("""SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z#]*') AS letters, regexp_full_match(c_name, '[A-Za-z#0-9]*') AS every, regexp_matches(c_name, '[789]') AS high,
CASE WHEN regexp_matches(c_name, '[1-9]') THEN CAST(length(regexp_extract(c_name, '^[^1-9]*')) AS BIGINT) ELSE -1 END AS first FROM customer""")
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All, any and first of the bytes that belong to a set."""
    letters = bytes(range(65, 91)) + bytes(range(97, 123)) + b"#"
    b = F.encode("c_name", "UTF-8")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", B.all_in(b, letters).alias("letters"), B.all_in(b, letters + b"0123456789").alias("every"), B.any_in(b, b"789").alias("high"), B.index_of_any(b, b"123456789").cast("long").alias("first")
    )


@query("SELECT count(*) AS rows, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes that a scan has passed on, seen while it is written elsewhere."""
    from pyspark.sql import Observation

    seen = Observation()
    docs = _docs(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    docs.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows long, bytes long")


@query("""SELECT n_nationkey, sha1(CAST(n_nationkey + p AS VARCHAR)) AS parent_id, CASE WHEN p = 2 AND n_nationkey % 3 = 0 THEN 'v' || n_name END AS tag FROM nation, (VALUES (1), (2)) v(p)""")
def merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of merges, each beside the tag that was merged, if one was."""
    from ..sources.formats import commit_row

    def bodies(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            out = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = [hashlib.sha1(str(k + p).encode()).hexdigest() for p in (1, 2)]
                tag = f"mergetag object {ids[1]}\n type commit\n tag v{name}\n tagger T <t@e> 1 +0000\n \n words\n" if k % 3 == 0 else ""
                row = commit_row(f"tree {'0' * 40}\nparent {ids[0]}\nparent {ids[1]}\nauthor A <a@b> 1 +0000\ncommitter A <a@b> 1 +0000\n{tag}\nmerge\n".encode())
                out += [(k, p, t) for p, t in zip(row["parent_ids"], row["merge_tags"], strict=True)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string()), strict=True)], names=["n_nationkey", "parent_id", "tag"])

    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(bodies, "n_nationkey int, parent_id string, tag string")


@query("SELECT n_nationkey, 'f' || n_nationkey AS name, CAST(1000000000 + n_nationkey AS BIGINT) AS time, n_name AS content, sha1(n_name) AS digest FROM nation")
def opened_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sealed with a pass phrase: file name, file time and content."""
    import hashlib
    import zlib

    from ..functions.secrets import decrypt

    def packet(tag: int, body: bytes) -> bytes:
        return bytes([0xC0 | tag, 255]) + struct.pack(">I", len(body)) + body

    def seal(name: bytes, k: int) -> bytes:
        key = C.derive_key(name, 16, "sha256", b"saltsalt", 1024)
        file = f"f{k}".encode()
        inner = packet(11, b"b" + bytes([len(file)]) + file + struct.pack(">I", 1000000000 + k) + name)
        inner = packet(8, b"\2" + zlib.compress(inner)) if k % 2 else inner
        plain = bytes(range(16)) + bytes([14, 15]) + inner + b"\xd3\x14"
        plain += hashlib.sha1(plain).digest()
        aes, last, out = C.Aes(key), b"\0" * 16, b""
        for i in range(0, len(plain), 16):
            last = C._xor(plain[i : i + 16], aes.encrypt(last))
            out += last
        return packet(3, bytes([4, 7, 3, 8]) + b"saltsalt" + bytes([0])) + packet(18, b"\1" + out)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = decrypt(seal(name.encode(), k), name.encode())
                rows.append((k, got["name"], got["time"], got["data"].decode()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["n_nationkey", "name", "time", "content"])

    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, name string, time long, content string")
    return rows.select("*", F.sha1(F.encode("content", "UTF-8")).alias("digest"))


_ENTRY32 = "list_reduce([i::BIGINT] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_ENTRY24 = "list_reduce([(i << 16)::BIGINT] || range(8), lambda a, k: CASE WHEN (a << 1) & 16777216 <> 0 THEN xor(a << 1, 25578747) ELSE a << 1 END)"


@query(f"""WITH t AS (SELECT list({_ENTRY32} ORDER BY i) AS t32, list({_ENTRY24} ORDER BY i) AS t24 FROM range(256) r(i)),
d AS (SELECT doc_id, list_transform(regexp_extract_all({_HEX}, '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents)
SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(t32[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc32,
list_reduce([11994318::BIGINT] || b, lambda c, x: xor((c << 8) & 16777215, t24[(xor(c >> 16, x) & 255) + 1])) AS crc24 FROM d, t""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.crc32(_body()).alias("crc32"), B.crc24(_body()).cast("long").alias("crc24"))


@query()
def long_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-384 and SHA-512, which DuckDB lacks; a test compares them with another implementation."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_body(), 384).alias("sha384"), F.sha2(_body(), 512).alias("sha512"))


@query("SELECT doc_id, sha256(text || coalesce(lang, '')) AS digest FROM documents")
def hash_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", B.hash_with_suffix(_body(), F.encode(F.coalesce("lang", F.lit("")), "UTF-8")).alias("digest"))


@query("SELECT doc_id, 'SIGNATURE' AS kind, md5(text) AS digest, doc_id % 7 = 0 AS broken FROM documents")
def armored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Armored blocks with a checksum; a block of a wrong checksum has no data."""
    crc = F.lpad(F.hex(B.crc24(_body())), 6, "0")
    wrong = F.lpad(F.hex((B.crc24(_body()) + 1) % (1 << 24)), 6, "0")
    block = lambda c: F.concat(F.lit("text\n-----BEGIN SIGNATURE-----\nVersion: 1\n\n"), B.base64_text(_body(), wrap=True), F.lit("\r\n="), F.regexp_replace(F.base64(F.unhex(c)), r"\s", ""), F.lit("\n-----END SIGNATURE-----\n"))
    docs = _docs(spark, sf_dir).select("doc_id", B.armor(block(crc)).alias("a"), B.armor(block(wrong)).alias("w"))
    return docs.select("doc_id", "a.kind", F.md5("a.data").alias("digest"), (F.col("w.data").isNull() & (F.col("doc_id") % 7 == 0)).alias("broken"))


def _sql_bytes(column: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda h: ('0x' || h)::BIGINT)"


def _sql_hex(expression: str) -> str:
    return f"array_to_string(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: printf('%02X', {expression})), '')"


@query(f"""WITH x AS (SELECT c_custkey, {_sql_bytes("c_name")} AS a, {_sql_bytes("c_mktsegment")} AS b FROM customer)
SELECT c_custkey, {_sql_hex("coalesce(a[i], 0) & coalesce(b[i], 0)")} AS "and", {_sql_hex("coalesce(a[i], 0) | coalesce(b[i], 0)")} AS "or", {_sql_hex("xor(coalesce(a[i], 0), coalesce(b[i], 0))")} AS "xor",
array_to_string(list_transform(a, lambda v: printf('%02X', 255 - v)), '') AS "not", array_to_string(list_transform(a, lambda v: printf('%02X', 0)), '') AS strict FROM x""")
def bit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of unequal length, the shorter followed by zeros; the strict form takes equal lengths."""
    a, b = F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    return load(spark, sf_dir, "customer").select("c_custkey", *[F.hex(B.bitwise(a, b, k)).alias(k) for k in ("and", "or", "xor")], F.hex(B.bitwise_not(a)).alias("not"), F.hex(B.bitwise(a, a, "xor", strict=True)).alias("strict"))


def _septets(value: Column, big: bool, less: int = 0) -> Column:
    """Hexadecimal bytes of a number in groups of seven bits; all but the last byte have the top bit.

    ``less`` is taken off each group's carry, as forms do that have one code for each number.
    """
    groups = [value]
    for _ in range(5):
        groups.append(F.shiftright(groups[-1], 7) - less)
    there = [F.lit(True)] + [(g >= 0) if less else (g > 0) for g in groups[1:]]
    rank = [F.lit(True)]
    for t in there[1:]:
        rank.append(rank[-1] & t)
    one = lambda g, more: F.lpad(F.hex(g.bitwiseAND(127) + F.when(more, 128).otherwise(0)), 2, "0")
    order = list(range(len(groups)))
    out = []
    for i in reversed(order) if big else order:
        more = F.lit(i > 0) if big else (rank[i + 1] if i + 1 < len(groups) else F.lit(False))
        out.append(F.when(rank[i], one(groups[i], more)).otherwise(""))
    return F.unhex(F.concat(*out))


@query("SELECT o_orderkey, o_orderkey * 7919 AS size_value, o_orderkey * 7919 AS offset_value, o_orderkey * 7919 AS plain_value FROM orders")
def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of one to five bytes in the three forms."""
    v = F.col("o_orderkey") * 7919
    made = {"size": _septets(v, False), "offset": _septets(v, True, 1), "plain": _septets(v, True)}
    return load(spark, sf_dir, "orders").select("o_orderkey", *[B.varint(b, k).cast("long").alias(f"{k}_value") for k, b in made.items()])


@query("SELECT doc_id, md5(text) AS utf16, md5(text) AS utf32 FROM documents")
def recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _body()
    return _docs(spark, sf_dir).select("doc_id", *[F.md5(B.recode(B.recode(b, "utf-8", c), c)).alias(n) for n, c in (("utf16", "utf-16-be"), ("utf32", "utf-32-le"))])


@query("""WITH x AS (SELECT doc_id, replace(replace(text, ' ', chr(13) || chr(10)), 'e', chr(13)) AS t FROM documents),
y AS (SELECT doc_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS n FROM x)
SELECT doc_id, md5(n) AS digest, CAST(len(string_split(n, chr(10))) - CASE WHEN right(n, 1) = chr(10) OR n = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM y""")
def eol_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriage returns, line feeds and both in one text."""
    mixed = F.replace(F.replace("text", F.lit(" "), F.lit("\r\n")), F.lit("e"), F.lit("\r"))
    every = ("crlf", "lf", "cr")
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_eols(mixed, every, "\n")).alias("digest"), F.size(X.lines(mixed, every)).cast("long").alias("n_lines"))


# ---- responses ----


@query("SELECT doc_id, 200 AS status, 'text/plain' AS kind, md5(text) AS digest FROM documents")
def http_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked and compressed bodies are undone."""
    from ..sources.formats import http_response

    coding = F.when(F.col("doc_id") % 2 == 0, "gzip").otherwise("deflate")
    packed = F.when(F.col("doc_id") % 2 == 0, B.compress(_body(), "gzip")).otherwise(B.compress(_body(), "zlib"))
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\nContent-Encoding: "), coding, F.lit("\r\n\r\n")), "UTF-8")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            got = [http_response(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g["status"] for g in got], pa.int32()), pa.array([g["headers"]["content-type"] for g in got]), pa.array([g["body"] for g in got], pa.binary())], names=["doc_id", "status", "kind", "body"])

    rows = _docs(spark, sf_dir).select("doc_id", F.concat(head, B.http_chunk(packed)).alias("raw")).mapInArrow(read, "doc_id long, status int, kind string, body binary")
    return rows.select("doc_id", "status", "kind", F.md5("body").alias("digest"))


# ---- deltas and differences ----


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's text beside that of the next of its nation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    text = F.concat_ws("\n", "c_mktsegment", "c_name", F.repeat("c_mktsegment", 20), F.col("c_custkey").cast("string"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.encode(text, "UTF-8").alias("own"))
    return rows.withColumn("base", F.coalesce(F.lag("own").over(w), F.lit(bytearray(b""))))


_TEXT = "encode(c_mktsegment || chr(10) || c_name || chr(10) || repeat(c_mktsegment, 20) || chr(10) || c_custkey)"


@query(f"SELECT c_custkey, md5({_TEXT}) AS copied, md5({_TEXT}) AS windows, md5({_TEXT}) AS packed FROM customer")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy deltas and window deltas of two versions, applied to the text they were made from."""
    rows = _pairs(spark, sf_dir).select("c_custkey", "base", B.each(P.copy_delta, "binary", F.col("base"), F.col("own")).alias("c"), *[B.each(lambda a, b, v=v: D.make_window_delta(a, b, v), "binary", F.col("base"), F.col("own")).alias(f"w{v}") for v in (0, 1)])
    applied = {"copied": D.apply_delta(F.col("base"), F.col("c")), "windows": D.apply_delta(F.col("base"), F.col("w0"), windows=True), "packed": D.apply_delta(F.col("base"), F.col("w1"), windows=True)}
    return rows.select("c_custkey", *[F.md5(v).alias(k) for k, v in applied.items()])


_TOKENS = "p_size + 5"


@query("""SELECT p_partkey, CAST((p_size + 4) // 3 + 1 AS BIGINT) AS deleted, CAST(1 + (p_size + 5) // 4 AS BIGINT) AS inserted, CAST(p_size + 5 - ((p_size + 4) // 3 + 1) AS BIGINT) AS kept, true AS changes FROM part""")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without each third token, with a new one before each fourth that was there: what differs is known."""
    n = F.expr(_TOKENS)
    a = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("t"), i))
    new = F.transform(F.sequence(F.lit(0), F.floor(n / 4).cast("int")), lambda i: F.concat(F.lit("n"), i))
    left = F.filter(a, lambda t: F.substring(t, 2, 9).cast("int") % 3 != 0)
    b = F.concat(new, left)
    found = load(spark, sf_dir, "part").select("p_partkey", D.diff_chunks(a, b).alias("c"))
    size = lambda keep, x, y: F.aggregate(F.filter("c", keep), F.lit(0).cast("long"), lambda s, c: s + c[y] - c[x])
    return found.select(
        "p_partkey", size(lambda c: c["changed"], "orig_start", "orig_end").alias("deleted"), size(lambda c: c["changed"], "mod_start", "mod_end").alias("inserted"),
        size(lambda c: ~c["changed"], "orig_start", "orig_end").alias("kept"), D.has_changes(F.col("c")).alias("changes"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN p_size % 3 = 0 OR p_size % 5 = 0 ELSE false END AS both,
CAST(CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS changed FROM part""")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of one list: whether both sides differ from it, and how many changed stretches there are."""
    base = F.array(*[F.lit(x) for x in "abcdefg"])
    edit = lambda c, at, by: F.when(c, F.transform(base, lambda t, i: F.when(i == at, F.lit(by)).otherwise(t))).otherwise(base)
    own = F.when(F.col("p_size") % 5 == 0, edit(F.lit(True), 3, "x")).otherwise(edit(F.col("p_size") % 2 == 0, 1, "y"))
    other = F.when(F.col("p_size") % 5 == 0, edit(F.lit(True), 3, "z")).otherwise(edit(F.col("p_size") % 3 == 0, 5, "w"))

    def merge(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(D.three_way(o, m, x), m != o and x != o) for o, m, x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([y for _, y in rows]), pa.array([sum(c[0] for c in f) for f, _ in rows], pa.int64())], names=["p_partkey", "both", "changed"])

    return load(spark, sf_dir, "part").select("p_partkey", base.alias("o"), own.alias("m"), other.alias("x")).mapInArrow(merge, "p_partkey long, both boolean, changed long")


# ---- packets, values and signatures ----


def _length(n: Column) -> Column:
    """A packet's length in one, two or five bytes."""
    two = F.concat(F.lpad(F.hex(F.shiftright(n - 192, 8) + 192), 2, "0"), F.lpad(F.hex((n - 192).bitwiseAND(255)), 2, "0"))
    return F.unhex(F.when(n < 192, F.lpad(F.hex(n), 2, "0")).when(n < 8384, two).otherwise(F.concat(F.lit("FF"), F.lpad(F.hex(n), 8, "0"))))


@query("""SELECT doc_id, 11 AS tag, md5(text) AS digest, 13 AS next_tag, coalesce(lang, '') AS next_body FROM documents""")
def pgp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of all three lengths, one behind the other."""
    lang = F.encode(F.coalesce("lang", F.lit("")), "UTF-8")
    raw = F.concat(F.lit(bytearray([0xC0 | 11])), _length(F.length(_body())), _body(), F.lit(bytearray([0xC0 | 13])), _length(F.length(lang)), lang)
    p = _docs(spark, sf_dir).select("doc_id", C.packets(raw).alias("p"))
    return p.select("doc_id", F.col("p")[0]["tag"].alias("tag"), F.md5(F.col("p")[0]["body"]).alias("digest"), F.col("p")[1]["tag"].alias("next_tag"), F.decode(F.col("p")[1]["body"], "UTF-8").alias("next_body"))


@query("SELECT doc_id, md5(text) AS digest, CAST(doc_id % 200 AS BIGINT) AS number FROM documents")
def der_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An octet string of a long length and an integer."""
    n = F.length(_body())
    raw = F.concat(F.lit(bytearray([4])), F.unhex(F.concat(F.lit("84"), F.lpad(F.hex(n), 8, "0"))), _body(), F.unhex(F.concat(F.lit("0202"), F.lpad(F.hex(F.col("doc_id") % 200), 4, "0"))))
    d = _docs(spark, sf_dir).select("doc_id", C.der(raw).alias("d"))
    return d.select("doc_id", F.md5(F.col("d")[0]["body"]).alias("digest"), F.conv(F.hex(F.col("d")[1]["body"]), 16, 10).cast("long").alias("number"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 3 THEN n_name END AS principal, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 3 AS valid FROM nation")
def signed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed commits and tags against a table of keys: each fifth signature is of another text, each seventh key is not listed."""
    import base64

    rows, keys = [], []
    for r in _names(spark, sf_dir):
        k, name = r["n_nationkey"], r["n_name"]
        seed = name.encode().ljust(32, b".")[:32]
        who = W.person(name, f"n{k}@example.com", 1000000000 + k, 0)
        plain = W.commit_bytes("0" * 40, [], who, who, f"Add {name}\n") if k % 2 else W.tag_bytes("0" * 40, "commit", name, who, f"Tag {name}\n")
        text = base64.b64encode(ssh_signed(seed, plain + b"!" * (k % 5 == 0))).decode()
        lines = ["-----BEGIN SSH SIGNATURE-----", *(text[i : i + 70] for i in range(0, len(text), 70)), "-----END SSH SIGNATURE-----"]
        head, _, message = plain.partition(b"\n\n")
        body = head + b"\ngpgsig " + "\n ".join(lines).encode() + b"\n\n" + message if k % 2 else plain + "\n".join(lines).encode() + b"\n"
        rows.append((str(k), "commit" if k % 2 else "tag", bytearray(body)))
        blob = _string(b"ssh-ed25519") + _string(C.ed25519_public(seed))
        if k % 7 != 3:
            keys.append((S.fingerprint_of(blob), name, bytearray(blob)))
    found = S.verified(spark.createDataFrame(rows, "id string, type string, content binary"), spark.createDataFrame(keys, "fingerprint string, principal string, key binary"))
    return found.select(F.col("id").cast("int").alias("n_nationkey"), "principal", "valid")


def _string(b: bytes) -> bytes:
    return struct.pack(">I", len(b)) + b


def ssh_signed(seed: bytes, message: bytes) -> bytes:
    """An SSH signature block of a message."""
    import hashlib

    digest = hashlib.sha512(message).digest()
    signed = b"SSHSIG" + b"".join(map(_string, (b"git", b"", b"sha512", digest)))
    key = _string(b"ssh-ed25519") + _string(C.ed25519_public(seed))
    value = _string(b"ssh-ed25519") + _string(C.ed25519_sign(seed, signed))
    return b"SSHSIG" + struct.pack(">I", 1) + b"".join(map(_string, (key, b"git", b"", b"sha512", value)))


@query("SELECT c_custkey, sha256(c_mktsegment || c_name) AS salted, sha256(c_name) AS plain FROM customer")
def derived_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys from pass phrases, with a salt and without."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("p"), F.encode("c_mktsegment", "UTF-8").alias("s"))
    return c.select("c_custkey", F.lower(F.hex(B.each(lambda p, s: C.derive_key(p, 32, "sha256", s), "binary", F.col("p"), F.col("s")))).alias("salted"), F.lower(F.hex(B.each(lambda p: C.derive_key(p, 32), "binary", F.col("p")))).alias("plain"))


# ---- tables of single files ----


def _file(spark: SparkSession, name: str, files: dict[str, bytes]) -> str:
    path = local_path(spark, name)
    for n, data in files.items():
        with open(os.path.join(path, n), "wb") as f:
            f.write(data)
    return path


def _names(spark: SparkSession, sf_dir: str) -> list:
    return load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


@query("SELECT 'lines' AS file, CAST(n_nationkey * 2 AS INTEGER) AS seq, n_name AS payload FROM nation UNION ALL SELECT 'lines', n_nationkey * 2 + 1, NULL FROM nation")
def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed lines, a flush behind each."""
    data = b"".join(b"%04x" % (len(r["n_name"]) + 4) + r["n_name"].encode() + b"0000" for r in _names(spark, sf_dir))
    return R.load(spark, _file(spark, "packets", {"lines": data}), "packet_lines").select("file", "seq", F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT 'r' || n_regionkey AS file, n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def hash_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files: dict[str, bytes] = {}
    for r in _names(spark, sf_dir):
        k, v = r["n_name"].encode(), str(r["n_nationkey"]).encode()
        files[f"r{r['n_regionkey']}"] = files.get(f"r{r['n_regionkey']}", b"") + b"K %d\n%s\nV %d\n%s\n" % (len(k), k, len(v), v)
    path = _file(spark, "dumps", {n: d + b"END\n" for n, d in files.items()})
    return R.load(spark, path, "hash_dump").select("file", "key", F.decode("value", "UTF-8").alias("value"))


@query("SELECT 'head' AS file, n_name AS key, 'nation ' || n_nationkey AS value FROM nation")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = "".join(f"{r['n_name']}: nation {r['n_nationkey']}\n" for r in _names(spark, sf_dir)) + "\nnot: this\n"
    return R.load(spark, _file(spark, "headers", {"head": data.encode()}), "headers")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN n_nationkey = 0 THEN 'PLAIN' ELSE 'DELTA' END AS kind, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) OVER (ORDER BY n_nationkey) AS text FROM nation")
def revision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision's text is a delta to that of the revision before, back to a plain one."""
    files, before = {}, b""
    for r in _names(spark, sf_dir):
        k, text = r["n_nationkey"], before + r["n_name"].encode() + b"\n"
        raw = b"PLAIN\n" + text if not k else b"DELTA %d 0 %d\n" % (k - 1, len(before)) + D.make_window_delta(before, text, k % 2)
        files[str(k)], before = raw + b"ENDREP\nid: x\n", text
    return R.load(spark, _file(spark, "revisions", files), "revision_texts").select("file", "kind", F.decode("text", "UTF-8").alias("text"))


@query("""SELECT 3 AS version, 'capability' AS kind, NULL AS id, 'object-format=sha1' AS name UNION ALL SELECT 3, 'reference', sha1(n_name), 'refs/heads/' || n_name FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 3, 'prerequisite', sha1(n_name), 'before ' || n_name FROM nation WHERE n_nationkey % 2 = 1""")
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.load(spark, _bundle(spark, sf_dir), "bundle").select("version", "kind", "id", "name")


def _bundle(spark: SparkSession, sf_dir: str) -> str:
    import hashlib

    rows = _names(spark, sf_dir)
    name = lambda r: hashlib.sha1(r["n_name"].encode()).hexdigest()
    head = "# v3 git bundle\n@object-format=sha1\n" + "".join(f"-{name(r)} before {r['n_name']}\n" for r in rows if r["n_nationkey"] % 2) + "".join(f"{name(r)} refs/heads/{r['n_name']}\n" for r in rows if not r["n_nationkey"] % 2)
    return _file(spark, "bundles", {"b": head.encode() + b"\n" + W.pack_bytes([("blob", r["n_name"].encode()) for r in rows])})


@query("SELECT sha1(encode('blob ' || length(n_name)) || '\\x00'::BLOB || encode(n_name)) AS id, 'blob' AS type, n_name AS content FROM nation")
def bundle_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.load(spark, _bundle(spark, sf_dir), "bundle_objects").select("id", "type", F.decode("content", "UTF-8").alias("content"))


# ---- writers ----


@query("""SELECT sha1(encode('blob ' || octet_length(encode(p_name || chr(10)))) || '\\x00'::BLOB || encode(p_name || chr(10))) AS id, CAST(length(p_name) + 1 AS BIGINT) AS size FROM part GROUP BY p_name""")
def written_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows become objects by content, once each, through the sink, and are read back."""
    path = local_path(spark, "written")
    W.init(path)
    body = F.encode(F.concat("p_name", F.lit("\n")), "UTF-8")
    W.save_objects(load(spark, sf_dir, "part").select(F.lit("blob").alias("type"), body.alias("content")), path)
    return R.load(spark, path, "objects").select("id", "size")


@query("""SELECT 'refs/heads/r' || r_regionkey AS name, CAST(count(*) AS BIGINT) AS commits, string_agg(n_name, ',' ORDER BY n_nationkey) AS files FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command stream of a commit a nation on its region's branch: length of each branch and the files of its last tree."""
    from ..operators import graph as G

    out = []
    for r in _names(spark, sf_dir):
        text = f"{r['n_name']}\n"
        out.append(f"commit refs/heads/r{r['n_regionkey']}\nmark :{r['n_nationkey'] + 1}\ncommitter K <k@e> {1000 + r['n_nationkey']} +0000\ndata {len(text)}\n{text}M 100644 inline \"{r['n_name']}\"\ndata {len(text)}\n{text}\n")
    path = local_path(spark, "imported")
    W.fast_import(W.init(path), "".join(out).encode())
    t = lambda name: R.load(spark, path, name)
    tips = R.branches(t("refs")).select("name", "id")
    walk = G.first_parent_walk(t("commit_parents"), tips.select("id")).groupBy("seed").agg(F.count(F.lit(1)).alias("commits"))
    trees = t("commits").select("id", "tree_id")
    keys = load(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    order = t("tree_entries").join(keys, F.col("name") == F.col("n_name")).groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").alias("files"))
    return tips.join(walk, F.col("id") == F.col("seed")).join(trees, "id").join(order, "tree_id").select("name", "commits", "files")
