"""WARC archives and HTML extraction."""

import base64
import gzip
import hashlib
import html
import io
import random
import re

import pytest

from strandline.llm import html as extraction
from strandline.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def rows_of(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


def test_warc(ship, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", None), (3, None, ""), (4, "u", "abc"), (5, "u", "é" * 300_000), (None, "u", "abc"), (7, "x\r\ny", "a\r\n\r\nb"), (8, "v", "only")]
    got = {r["page_id"]: r for r in rows_of(ship, tmp_path, rows, "op1_warc")}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 1), 5: ("response", None), None: ("revisit", 1), 7: ("response", None), 8: ("response", None),
    }


def test_warc_of_clashing_columns_and_any_ids(ship, tmp_path):
    rows = [("a:b", "u", "same"), ("c", "u", "same"), (":", "u", "x" * 2_000_000), (None, None, None)]
    df = ship.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", *[f"'x' AS {c}" for c in "first sha n path payload record_id".split()])
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in queries.QUERIES["op1_warc"](ship, str(tmp_path)).collect()}
    assert got == {"a:b": ("response", None, 4), "c": ("revisit", "a:b", 4), ":": ("response", None, 2_000_000), None: ("response", None, 0)}


def test_warc_of_no_pages(ship, tmp_path):
    assert rows_of(ship, tmp_path, [], "op1_warc") == []


def test_normaliser_and_index(ship):
    records = [warc.record("response", f"urn:page:{i}", "u", "D", len(p), p) for i, p in enumerate((b"", b"x" * 100_000, b"a\r\n\r\nb"))]
    for stream in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(records[0]) + gzip.compress(b"".join(records[1:]))):
        out = io.BytesIO()
        index = list(warc.normalise_stream(io.BytesIO(stream), out))
        assert [data for _, _, data in index] == records
        for at, size, data in index:  # each record can be read alone
            assert gzip.decompress(out.getvalue()[at : at + size]) == data
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(records[1])[:-10]))))


def test_payloads_read_back(ship):
    pages = ship.createDataFrame([(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>")], SCHEMA)
    got = {r["record_id"]: r for r in warc.read_archives(*warc.archive(pages)).collect()}
    assert bytes(got["urn:page:1"]["payload"]).decode() == "<p>é</p>" and got["urn:page:2"]["payload"] is None


def page(i, rng, notice=""):
    paragraphs = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta &amp; &lt;iota&gt;".split(), k=rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
    title = f"Title {i} &amp; more"
    body = "".join(f"<p>{p}</p>" if k % 2 else f"<p><b>{p}<br>" for k, p in enumerate(paragraphs))
    want = "\n".join(" ".join(html.unescape(x).split()) for x in [title, *paragraphs])
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x{i}</a></li></ul></nav>{notice}<!-- ad --><div class="ad">Buy {i}.</div><article><h1>{title}</h1>{body}</article><section class="comments"><p>first {i}</p></section><aside>more</aside><form><input name=q>go</form><footer>&copy; {i}</footer></body></html>', want


def test_articles(ship, tmp_path):
    rng = random.Random(1)
    made = [page(i, rng, '<div class="cookie-notice">We use cookies</div>') for i in range(120)]
    rows = [(i, f"http://h{0 if i < 90 else i}.example.com/{i}", h) for i, (h, _) in enumerate(made)]
    rows += [(900, None, None), (901, "http://h0.example.com/", ""), (902, "x", "plain words only"), (903, "y", made[5][0][:-40])]
    got = {r["page_id"]: r for r in rows_of(ship, tmp_path, rows, "op7_html")}
    assert [i for i, (_, want) in enumerate(made) if got[i]["text"] != want] == []
    assert got[900]["text"] == "" and got[901]["n_chars"] == 0 and got[902]["text"] == "plain words only" and got[903]["text"] == made[5][1]


def test_pages_without_an_article_element():
    """The template's slots decide: constant text and link lists go, what differs stays."""
    rng = random.Random(2)
    words = "red green blue white black pink cyan grey".split()
    texts = [" ".join(rng.choices(words, k=60)) + str(i) for i in range(10)]
    pages = [f"<html><body><div id=top>Welcome to our site</div><div id=l><a href=a>one {i}</a> <a href=b>two</a></div><div id=m>{t}</div><div id=b>All rights reserved</div></body></html>" for i, t in enumerate(texts)]
    assert extraction.extract(pages) == texts


def test_template_texts_within_the_article_element():
    """Texts that repeat go from articles, too; copies of one article are no template; pages without the element are scored by themselves."""
    rng = random.Random(3)
    words = "red green blue white black pink cyan grey".split()
    texts = [" ".join(rng.choices(words, k=60)) + str(i) for i in range(8)]
    shell = "<html><body><div id=top>Our site</div>{}<div id=b>All rights</div></body></html>".format
    tip = "<p class=tip>Read on</p>"
    pages = [shell(f"<article><p>By our staff</p><div id=m>{t}</div>{tip * (2 + i % 2)}</article>") for i, t in enumerate(texts[:5])]
    pages += [shell(f"<div id=m>{t}</div><div id=s>note {i}</div>{tip * 2}<p>By our staff</p>") for i, t in enumerate(texts[5:])]
    assert extraction.extract(pages[:5]) == texts[:5]
    assert extraction.extract(pages[:5] + [""]) == [*texts[:5], ""]
    assert extraction.extract(pages[5:]) == [f"{t}\nnote {i}" for i, t in enumerate(texts[5:])]
    assert extraction.extract(pages[:1] * 5)[0] == f"By our staff\n{texts[0]}\nRead on\nRead on"
    mixed = extraction.extract(pages)
    assert all(t in x and "By our staff" not in x for t, x in zip(texts, mixed, strict=True))


def test_equivalence_classes():
    keys = [["<a", "t:x", "</a", "<b", "t:1", "</b"], ["<a", "t:x", "</a", "<b", "t:2", "</b", "<b", "t:3", "</b"]]
    found = extraction.classes(keys)
    assert set(found[(1, 1)]) == {"<a", "t:x", "</a"} and set(found[(1, 2)]) == {"<b", "</b"}
    template = extraction.Template([*keys, keys[1]])
    assert [bytes(m) for m in template.member] == [b"\1\1\1\1\0\1"] + [b"\1\1\1\1\0\1\1\0\1"] * 2
    assert bytes(extraction.Template(keys).member[1]) == b"\1\1\1" + b"\0" * 6


def test_nested_classes():
    """A list in the root's slot, with items that hold lists themselves; the texts of each level's class are known."""
    rng = random.Random(6)

    def made(n):
        items = "".join("<li><b>item</b>" + "".join(f"<i>by</i><u>{rng.random()}</u>" for _ in range(rng.randint(2, 4))) + "</li>" for _ in range(n))
        return f"<body><ul>{items}</ul><div>{rng.random()}</div></body>"

    pages = [extraction.tokens(made(n)) for n in (2, 3, 2, 4)]
    keys = [extraction.keyed(p) for p in pages]
    template = extraction.Template(keys)
    for page, k, member in zip(pages, keys, template.member, strict=True):
        texts = [(name, bool(m)) for (kind, name, _), m in zip(page, member, strict=True) if kind == extraction.TEXT]
        assert all(m == (name in ("item", "by")) for name, m in texts) and {"item", "by"} <= {n for n, _ in texts}
        assert [x in ("<body #", "<ul #", "/ul", "<div #", "/div", "/body") or m for x, m in zip(k, member, strict=True)].count(True) == len(k) - len([x for x in texts if not x[1]])


def test_slots_decide_for_broken_pages():
    """A page whose article element is missing or never ends is read like the group's others; without the template it is not."""
    rng = random.Random(7)
    body = lambda: " ".join(rng.choices("red green blue white black".split(), k=30)) + str(rng.random())
    made = [(body(), f"advert {rng.random()}", f"see also {rng.random()}") for _ in range(12)]
    page = "<html><body><div id=x>{1}</div>{open}<div id=m><p>{0}</p></div>{close}<div id=z>{2}</div></body></html>".format
    pages = [page(*m, open="<article>", close="</article>") for m in made[:10]]
    pages += [page(*made[10], open="", close=""), page(*made[11], open="<article>", close="")]
    assert extraction.extract(pages) == [m[0] for m in made]
    assert extraction.extract(pages[10:11]) != [made[10][0]] and extraction.extract(pages[11:]) != [made[11][0]]


def test_html_of_nothing_clashes_and_repeated_rows(ship, tmp_path):
    assert rows_of(ship, tmp_path / "none", [], "op7_html") == []
    rng = random.Random(8)
    rows = [(i % 7, f"http://h.example.com/{i % 7}", page(i % 7, random.Random(i % 7))[0]) for i in range(40)] + [(None, None, None)] * 3
    plain = rows_of(ship, tmp_path / "plain", rows, "op7_html")
    assert len(plain) == 43 and all(r["text"] == (page(r["page_id"], random.Random(r["page_id"]))[1] if r["page_id"] is not None else "") for r in plain)
    df = ship.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in "host salt salts copies key text n_chars copy a_id".split()])
    assert sorted(map(repr, extraction.main_text(df).collect())) == sorted(map(repr, plain))
    long = "<p>" + "word " * 200_000 + "</p>"
    assert extraction.extract([f"<article>{long}</article>"])[0] == ("word " * 200_000).strip()
