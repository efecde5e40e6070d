"""Queries of the text, byte, bit and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import diff as D
from ..functions import text as X
from ..operators.sequence import By, Sequence
from .registry import query
from .tables import load


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


# ---- text ----


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\n')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
string_split(text, chr(10))[1] AS head FROM documents""")
def eol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.lines(F.col("text"), ("lf",))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_lines"), F.get(found, F.lit(0))["line"].alias("head"))


@query("SELECT doc_id, md5(replace(text, chr(10), chr(13) || chr(10))) AS digest FROM documents")
def eol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_eols(F.col("text"), ("lf",), "\r\n")).alias("digest"))


@query("SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS head FROM documents")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.first_line(F.col("text")).alias("head"))


@query("""WITH l AS (SELECT doc_id, list_slice(string_split(replace(text, chr(13), ''), chr(10)), 1, 4) AS p FROM documents),
c AS (SELECT doc_id, p, list_position(list_transform(p, lambda x: trim(x, ' ') = ''), true) AS b FROM l)
SELECT doc_id, md5(array_to_string(CASE WHEN b > 0 THEN list_slice(p, 1, b - 1) ELSE p END, chr(10))) AS digest FROM c""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.summary(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(text, chr(10), chr(10) || ' '), chr(10) || ' ', chr(10))) AS digest, CAST(length(replace(text, chr(10), chr(10) || ' ')) AS BIGINT) AS n FROM documents")
def indent_unindent(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.indent(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.unindent(wide)).alias("digest"), F.length(wide).cast("long").alias("n"))


_REF = "CASE o_orderkey % 5 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/remotes/origin/' WHEN 2 THEN 'refs/tags/' WHEN 3 THEN 'refs/notes/' ELSE 'HEAD' END || o_orderpriority"


@query(f"""WITH r AS (SELECT o_orderkey, {_REF} AS name FROM orders) SELECT o_orderkey, CASE WHEN name LIKE 'refs/heads/%' THEN substr(name, 12)
WHEN name LIKE 'refs/remotes/%' THEN substr(name, 14) WHEN name LIKE 'refs/tags/%' THEN substr(name, 11) WHEN name LIKE 'refs/%' THEN substr(name, 5) ELSE name END AS short FROM r""")
def short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", X.short_ref(F.expr(_REF)).alias("short"))


@query(f"""WITH r AS (SELECT o_orderkey, {_REF} || CASE WHEN o_orderkey % 7 = 0 THEN '..x' WHEN o_orderkey % 7 = 1 THEN '.lock' ELSE '' END AS name FROM orders)
SELECT o_orderkey, name LIKE '%/%' AND NOT contains(name, ' ') AND NOT contains(name, '..') AND NOT name LIKE '%.lock' AS valid FROM r""")
def valid_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(f"{_REF} || CASE WHEN o_orderkey % 7 = 0 THEN '..x' WHEN o_orderkey % 7 = 1 THEN '.lock' ELSE '' END")
    return load(spark, sf_dir, "orders").select("o_orderkey", X.valid_ref(name).alias("valid"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/]*/en/[^/]*$') AS hit FROM pages")
def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", X.glob_match(F.col("url"), "https://*/en/*").alias("hit"))


_BOOL = "CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN 'On' WHEN 3 THEN '1' WHEN 4 THEN 'no' WHEN 5 THEN 'OFF' WHEN 6 THEN '' ELSE 'maybe' END"


@query(f"""WITH v AS (SELECT event_id, lower({_BOOL}) AS v FROM events) SELECT event_id, CASE WHEN v IN ('true', 'yes', 'on', '1') THEN true WHEN v IN ('false', 'no', 'off', '0', '') THEN false END AS flag FROM v""")
def config_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", X.config_bool(F.expr(_BOOL)).alias("flag"))


_INT = "CAST(event_id % 1000 AS VARCHAR(10)) || CASE event_id % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN 'g' WHEN 3 THEN '' ELSE 'q' END"


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN (event_id % 1000) * 1024 WHEN 1 THEN (event_id % 1000) * 1048576 WHEN 2 THEN (event_id % 1000) * 1073741824
WHEN 3 THEN event_id % 1000 END AS BIGINT) AS number FROM events""")
def config_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", X.config_int(F.expr(_INT)).alias("number"))


@query("SELECT c_custkey, c_name || chr(9) || 'a' || chr(10) || 'b\\c' AS value, '/home/me/' || c_name AS path FROM customer")
def config_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_name", F.lit("\\ta\\nb\\\\c"))
    return load(spark, sf_dir, "customer").select("c_custkey", X.config_unescape(raw).alias("value"), X.expand_home(F.concat(F.lit("~/"), "c_name"), "/home/me").alias("path"))


_SIGN = "'User ' || user_id || ' <u' || user_id || '@example.com> ' || (1000000000 + event_id) || CASE WHEN event_id % 2 = 0 THEN ' +0530' ELSE ' -0800' END"


@query("""SELECT event_id, 'User ' || user_id AS name, 'u' || user_id || '@example.com' AS email, CAST(1000000000 + event_id AS BIGINT) AS epoch,
CASE WHEN event_id % 2 = 0 THEN 330 ELSE -480 END AS tz_offset_min FROM events""")
def signature_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").select("event_id", X.parse_signature(F.expr(_SIGN)).alias("s"))
    return s.select("event_id", "s.name", "s.email", "s.epoch", "s.tz_offset_min")


@query(f"SELECT event_id, {_SIGN} AS line FROM events")
def signature_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").select("event_id", X.parse_signature(F.expr(_SIGN)).alias("s"))
    return s.select("event_id", X.format_signature(F.col("s.name"), F.col("s.email"), F.col("s.epoch"), F.col("s.tz_offset_min")).alias("line"))


@query("SELECT p_partkey, substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 8) AS short, upper(sha1(CAST(p_partkey AS VARCHAR))) AS upper_id, true AS valid, false AS zero FROM part")
def id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.sha1(F.col("p_partkey").cast("string").cast("binary"))
    return load(spark, sf_dir, "part").select("p_partkey", X.format_id(id_, 8).alias("short"), X.format_id(id_, upper=True).alias("upper_id"), X.is_id(F.concat(id_, F.lit(" "))).alias("valid"), X.is_zero_id(id_).alias("zero"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 33188 WHEN 1 THEN 33261 ELSE 16384 END::BIGINT AS mode FROM part")
def mode_octal(spark: SparkSession, sf_dir: str) -> DataFrame:
    octal = F.expr("CASE p_partkey % 3 WHEN 0 THEN '100644' WHEN 1 THEN '100755' ELSE '40000' END")
    return load(spark, sf_dir, "part").select("p_partkey", X.mode_of_octal(octal).alias("mode"))


# ---- bytes ----


@query("""SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, trim(string_split(text, ' ')[1], chr(10) || ' ') AS first FROM documents""")
def byte_split_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = B.split(F.encode("text", "UTF-8"), " ")
    return _docs(spark, sf_dir).select("doc_id", F.size(pieces).cast("long").alias("pieces"), F.decode(B.trim(F.get(pieces, F.lit(0))), "UTF-8").alias("first"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.encode("text", "UTF-8")
    return _docs(spark, sf_dir).select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


@query("SELECT doc_id, base64(encode(text)) AS encoded, md5(text) AS decoded FROM documents")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.encode("text", "UTF-8")
    return _docs(spark, sf_dir).select("doc_id", B.base64_text(b).alias("encoded"), F.md5(B.base64_bytes(B.base64_text(b, wrap=True))).alias("decoded"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS id FROM documents")
def object_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", B.object_id(F.lit("blob"), F.encode("text", "UTF-8")).alias("id"))


@query("SELECT doc_id, md5(text) AS zlib, md5(text) AS gzip, md5(text) AS deflate, md5(text) AS chunked FROM documents")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression and transfer codecs, by round trip."""
    b = F.encode("text", "UTF-8")
    docs = _docs(spark, sf_dir)
    back = {kind: B.decompress(B.compress(b, kind), kind) for kind in ("zlib", "gzip", "deflate")}
    return docs.select("doc_id", *[F.md5(v).alias(k) for k, v in back.items()], F.md5(B.http_dechunk(B.http_chunk(b))).alias("chunked"))


@query("SELECT doc_id, md5(text) AS utf8, md5(text) AS utf16 FROM documents")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 out of UTF-8 and of UTF-16 with a byte order mark."""
    marked = F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("text", "UTF-16LE"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(B.normalize_utf8(F.encode("text", "UTF-8"))).alias("utf8"), F.md5(B.normalize_utf8(marked)).alias("utf16"))


# ---- bits and numbers ----


@query("""SELECT l_orderkey, l_linenumber, l_orderkey & l_partkey AS both, l_orderkey | l_partkey AS either, xor(l_orderkey, l_partkey) AS one, ~l_orderkey AS inverse,
CAST(bit_count(l_orderkey) AS BIGINT) AS ones FROM lineitem""")
def bit_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("either"), a.bitwiseXOR(b).alias("one"), F.bitwise_not(a).alias("inverse"), F.bit_count(a).cast("long").alias("ones")
    )


@query("SELECT l_returnflag, bit_and(l_orderkey) AS both, bit_or(l_orderkey) AS either, bit_xor(l_orderkey) AS one FROM lineitem GROUP BY l_returnflag")
def bit_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bit_and("l_orderkey").alias("both"), F.bit_or("l_orderkey").alias("either"), F.bit_xor("l_orderkey").alias("one"))


@query("""SELECT event_id, (CAST(event_id % 1000 AS BIGINT) << 34) | CAST(floor(epoch(ts)) AS BIGINT) AS packed, CAST(event_id % 1000 AS BIGINT) AS generation, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events""")
def generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.expr("CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)")
    p = load(spark, sf_dir, "events").select("event_id", B.pack_generation(F.col("event_id") % 1000, epoch).alias("packed"))
    return p.select("event_id", "packed", B.unpack_generation(F.col("packed"))["generation"].alias("generation"), B.unpack_generation(F.col("packed"))["epoch"].alias("epoch"))


@query("SELECT o_orderkey, o_orderkey AS big, CAST(o_orderkey % 65536 AS BIGINT) AS small, CAST((o_orderkey & 12288) >> 12 AS BIGINT) AS stage FROM orders")
def network_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0"))
    return load(spark, sf_dir, "orders").select("o_orderkey", B.network_int(b, 0, 8, signed=True).alias("big"), B.network_int(b, 6, 2).alias("small"), B.stage_of(F.col("o_orderkey")).alias("stage"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CASE WHEN event_id % 2 = 0 THEN '+0530' ELSE '-0800' END AS zone FROM events")
def epoch_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("event_id") % 2 == 0, 330).otherwise(-480)
    epoch = F.expr("CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)")
    return load(spark, sf_dir, "events").select("event_id", epoch.alias("epoch"), X.format_zone(minutes).alias("zone"))


# ---- differences ----


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside its successor by id, lines as tokens."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    a = Sequence(rows, [By(F.col("doc_id"))])
    left = a.indexed().df
    right = left.select((F.col("__ordinal") - 1).alias("__ordinal"), F.col("lines").alias("next_lines"))
    return left.join(right, "__ordinal").select("doc_id", "lines", "next_lines")


@query()
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and unchanged chunks between neighbouring documents."""
    found = _neighbours(spark, sf_dir).select("doc_id", F.explode(D.diff_chunks(F.col("lines"), F.col("next_lines"))).alias("c"))
    return found.select("doc_id", "c.*")


@query()
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _neighbours(spark, sf_dir).select("doc_id", D.diff_chunks(F.col("lines"), F.col("next_lines")).alias("c"))
    return found.select("doc_id", D.has_changes(F.col("c")).alias("has_changes"), D.similarity(F.col("c")).alias("similarity"))


@query("""WITH a AS (SELECT l_orderkey || '/' || l_linenumber AS path, l_quantity AS v FROM lineitem WHERE l_discount < 0.08),
b AS (SELECT l_orderkey || '/' || l_linenumber AS path, l_quantity + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_discount > 0.01)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM (SELECT path, min(v) AS v FROM a GROUP BY path) a FULL OUTER JOIN (SELECT path, min(v) AS v FROM b GROUP BY path) b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v <> b.v""")
def path_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, deleted and modified paths between two snapshots."""
    items = load(spark, sf_dir, "lineitem")
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path")
    a = items.filter("l_discount < 0.08").groupBy(path).agg(F.min("l_quantity").alias("v"))
    more = F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    b = items.filter("l_discount > 0.01").groupBy(path).agg(F.min(more).alias("w"))
    both = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), "path", "full")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "deleted").otherwise("modified")
    return both.filter(F.col("l").isNull() | F.col("r").isNull() | (F.col("v") != F.col("w"))).select("path", change.alias("change"))
