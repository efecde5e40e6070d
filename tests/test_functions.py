import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.functions import binary as B
from strandline.functions import diff as D
from strandline.functions import text as X
from strandline.sources import packs as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_differences():
    """Changed chunks of small cases, worked out by hand."""
    changed = lambda a, b: [c[1:] for c in D.chunks(list(a), list(b)) if c[0]]
    assert changed("kitten", "kitten") == [] and changed("", "") == []
    assert changed("abc", "xyz") == [(0, 3, 0, 3)] and changed("", "ab") == [(0, 0, 0, 2)] and changed("ab", "") == [(0, 2, 0, 0)]
    assert changed("north", "forth") == [(0, 1, 0, 1)] and changed("sand", "sands") == [(4, 4, 4, 5)]
    assert changed("ppqqq", "ppqq") == [(4, 5, 4, 4)]  # of equal places the latest
    assert changed("xyxy", "xyxyxy") == [(4, 4, 4, 6)]


def test_differences_are_longest_and_cover():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = D.chunks(a, b)
        assert sum(c[2] - c[1] for c in found) == len(a) and sum(c[4] - c[3] for c in found) == len(b)
        assert all(a[c[1] : c[2]] == b[c[3] : c[4]] for c in found if not c[0])
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(c[2] - c[1] for c in found if not c[0]) == table[-1][-1]
        # no run of changes on either side could stand one place later
        for tokens, at in ((a, 1), (b, 3)):
            flags = [False] * len(tokens)
            for c in found:
                if c[0]:
                    flags[c[at] : c[at + 1]] = [True] * (c[at + 1] - c[at])
            assert D._latest(tokens, flags) == flags


def test_similarity(spark):
    assert D.similarity_of(D.chunks(list("wxyz"), list("wxy"))) == 0.75
    assert D.similarity_of(D.chunks([], [])) == 1.0
    col = D.diff_chunks(F.array(*map(F.lit, "wxyz")), F.array(*map(F.lit, "wxy")))
    assert one(spark, D.similarity(col)) == pytest.approx(0.75) and one(spark, D.has_changes(col))
    assert D.three_way(list("mnop"), list("mnrop"), list("mnsop")) == [(False, (0, 2), (0, 2), (0, 2)), (True, (2, 2), (2, 3), (2, 3)), (False, (2, 4), (3, 5), (3, 5))]


def test_made_deltas():
    rng = random.Random(4)
    for _ in range(60):
        base = rng.randbytes(rng.randint(0, 400))
        cut = rng.randint(0, len(base))
        target = base[:cut] + rng.randbytes(rng.randint(0, 300)) + base[cut:]
        assert D.apply_copy_delta(base, P.copy_delta(base, target)) == target
        for version in (0, 1):
            assert D.apply_window_delta(base, D.make_window_delta(base, target, version)) == target
    assert len(P.copy_delta(b"x" * 200_000, b"x" * 200_000 + b"y")) < 40


def test_deltas(spark):
    base = b"hello brave world"
    delta = bytes([len(base), 11, 0x90, 6, 5]) + b"world"
    assert D.apply_copy_delta(base, delta) == b"hello world"
    assert bytes(one(spark, D.apply_delta(F.lit(bytearray(base)), F.lit(bytearray(delta))))) == b"hello world"
    code = bytes([0 << 6 | 5, 0, 2 << 6 | 1, 1 << 6 | 6, 0])  # copy from source, new data, copy from target with overlap
    window = b"SVN\0" + bytes([0, 5, 12, len(code), 1]) + code + b"!"
    assert D.apply_window_delta(b"hello", window) == b"hello!hello!"
    packed = zlib.compress(b"x" * 60)
    one_window = b"SVN\1" + bytes([0, 0, 60, 1 + 2, 1 + len(packed)]) + bytes([2]) + bytes([2 << 6, 60]) + bytes([60]) + packed
    assert D.apply_window_delta(b"", one_window) == b"x" * 60
    assert D.lz4_block(bytes([0x10 | 15, ord("a"), 1, 0, 10, 0x10, ord("b")]), 31) == b"a" * 30 + b"b"


TEXT = b"one line\nand another\r\nand the last"


def test_hashes_and_codecs(spark):
    b = F.lit(bytearray(TEXT))
    assert one(spark, F.md5(b)) == hashlib.md5(TEXT).hexdigest() and one(spark, F.sha1(b)) == hashlib.sha1(TEXT).hexdigest()
    # fixed values: the checksums' published check values of "123456789"
    assert one(spark, F.crc32(F.lit(bytearray(b"123456789")))) == 0xCBF43926 and one(spark, B.crc24(F.lit(bytearray(b"123456789")))) == 0x21CF02
    # fixed value: the published id of the empty blob
    assert one(spark, B.object_id(F.lit("blob"), F.lit(bytearray(b"")))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    for kind in ("zlib", "gzip", "deflate"):
        assert bytes(one(spark, B.decompress(B.compress(b, kind), kind))) == TEXT
    for text in (b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", b"\xff\x00" * 500):
        c = F.lit(bytearray(text))
        assert bytes(one(spark, B.base64_bytes(B.base64_text(c, wrap=True)))) == text
        assert bytes(one(spark, B.base64_bytes(B.base64_text(c, padding=False)))) == text
    assert max(map(len, one(spark, B.base64_text(F.lit(bytearray(b"q" * 900)), wrap=True)).split("\r\n"))) == 76


def test_byte_slices(spark):
    b = F.lit(bytearray(range(128)))
    assert bytes(one(spark, B.take(b, 130))) == bytes(range(128)) and bytes(one(spark, B.skip(b, 130))) == b""
    for f in (B.take_exactly, B.skip_exactly):
        with pytest.raises(Exception, match="fewer than 130"):
            one(spark, f(b, 130))
    assert one(spark, B.index_of(b, bytes([5, 6]))) == 5 and one(spark, B.index_of(b, b"\xff")) == -1
    assert bytes(one(spark, B.until(b, bytes([3])))) == bytes(range(4))
    assert [bytes(x) for x in one(spark, B.split(F.lit(bytearray(b"a,b,,c")), ","))] == [b"a", b"b", b"", b"c"]
    assert one(spark, B.ends_with(b, bytes([126, 127]))) and one(spark, B.starts_with(b, bytes([0, 1])))


@pytest.mark.parametrize("operator", ["and", "or", "xor"])
def test_bitwise_streams(spark, operator):
    rng = random.Random(5)
    x, y = rng.randbytes(901), rng.randbytes(640)
    got = bytes(one(spark, B.bitwise(F.lit(bytearray(x)), F.lit(bytearray(y)), operator)))
    f = {"and": int.__and__, "or": int.__or__, "xor": int.__xor__}[operator]
    assert got == bytes(f(p, q) for p, q in zip(x, y.ljust(len(x), b"\0"), strict=True))


def test_lines(spark):
    rows = one(spark, X.lines(F.lit("p\n\rqq\r\n\nr")))
    assert [(r["line"], r["eol"]) for r in rows] == [("p", "\n"), ("", "\r"), ("qq", "\r\n"), ("", "\n"), ("r", "")]
    assert one(spark, X.normalize_eols(F.lit("a\r\nb\rc\nd"), ("crlf", "lf"), "\n")) == "a\nb\rc\nd"
    assert one(spark, X.unindent(F.lit("key\n more\n  still\nnext"))) == "key\nmore\n still\nnext"
    assert one(spark, X.summary(F.lit("a\r\nb\n\nc"))) == "a\nb"


def test_names_and_globs(spark):
    assert one(spark, X.short_ref(F.lit("refs/notes/x"))) == "/notes/x" and one(spark, X.short_ref(F.lit("refs/heads/a/b"))) == "a/b"
    good, bad = ["refs/heads/x", "a/b"], ["x", "a//b", "a/.b", "a/b.lock", "a/b..c", "a/@{b", "a/b~", "/a/b", "a/b/", "a/b."]
    assert all(one(spark, X.valid_ref(F.lit(n))) for n in good) and not any(one(spark, X.valid_ref(F.lit(n))) for n in bad)
    assert one(spark, X.valid_ref(F.lit("HEAD"), allow_caps=True))
    for glob, path, hit in [("src/**/x.c", "src/a/b/x.c", True), ("src/**/x.c", "src/x.c", True), ("*.c", "a/b.c", False), ("a?[b-d]", "axc", True), ("a[!b]", "ab", False), ("\\*", "*", True)]:
        assert one(spark, X.glob_match(F.lit(path), glob)) == hit, (glob, path)
    assert one(spark, X.glob_match(F.lit("a/b.c"), "*.c", anywhere=True))


def test_values(spark):
    s = one(spark, X.parse_signature(F.lit("A B <a@b> 946681200 -0130")))
    assert (s["name"], s["email"], s["epoch"], s["tz_offset_min"]) == ("A B", "a@b", 946681200, -90)
    assert one(spark, X.config_int(F.lit("2k"))) == 2048 and one(spark, X.config_int(F.lit("2q"))) is None
    assert one(spark, X.config_bool(F.lit("Yes"))) is True and one(spark, X.config_bool(F.lit("perhaps"))) is None
    assert one(spark, X.config_unescape(F.lit("a\\\\nb\\tc\\\"d"))) == 'a\\nb\tc"d'
    packed = B.pack_generation(F.lit(9), F.lit(4102444800))
    got = one(spark, B.unpack_generation(packed))
    assert (got["generation"], got["epoch"]) == (9, 4102444800)
    assert B.offset_varint(bytes([0x80, 0]))[0] == 128 and B.size_varint(bytes([0x80, 1]))[0] == 128 and B.plain_varint(bytes([0x81, 0]))[0] == 128


def test_encodings(spark):
    text = "".join(map(chr, range(1, 255)))
    for data in (text.encode("utf-8-sig"), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), text.encode("utf-8"), text.encode("utf-16-le"), text.encode("latin-1")):
        assert one(spark, B.normalize_utf8(F.lit(bytearray(data)))) == text
    assert bytes(one(spark, B.recode(F.lit(bytearray("é€".encode("cp1252"))), "cp1252"))) == "é€".encode()


def test_armor(spark):
    import base64

    data = bytes(range(50))
    crc = base64.b64encode(B.crc24_of(data).to_bytes(3, "big")).decode()
    text = f"x\n-----BEGIN PGP SIGNATURE-----\nVersion: 1\n\n{base64.b64encode(data).decode()}\n={crc}\n-----END PGP SIGNATURE-----\n"
    assert bytes(one(spark, B.armor(F.lit(text)))["data"]) == data and B.armor_decode(text)["headers"] == {"Version": "1"}
    assert B.armor_decode(text.replace("AAEC", "AAED")) is None
