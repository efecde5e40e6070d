"""The operators over documents against brute force, with nulls, ties, copies, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandline.llm.common import SpanHash
from strandline.llm import edit_embedding, language, minhash, mixing, pieces, pii, queries, repeats, tiff

OPS = [q for q in queries.QUERIES if q not in ("op1_warc", "op7_html")]


def collected(spark, name, folder):
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", OPS)
def test_empty_table_and_clashing_columns(ship, tables, name):
    assert collected(ship, name, tables["empty"]) == []
    key = lambda rows: sorted(map(repr, rows))
    assert key(collected(ship, name, tables["clash"])) == key(collected(ship, name, tables["corpus"]))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


HARD = [
    "a@b.c.d%e@f.gh 1.2.3.4.5.6.7.8 999.1.1.1 0256.1.1.1 4111 1111 1111 1111 1111",
    "x" * 4000 + "@" + "a." * 3000 + "b", "1." * 4000, "1 " * 4000, "+12345678901 +1-2-3-4-5-6-7-8-9-0- é😀 a@b.cc", "@@a@b.c@d.e", "4111-1111-1111-1111,378282246310005",
]


def test_pii_base_spans(ship, tables, corpus, tmp_path):
    ship.createDataFrame([(i, t, None, None) for i, t in enumerate(HARD)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, texts in ((tables["corpus"], [r[1] for r in corpus]), (str(tmp_path), HARD)):
        got = queries.QUERIES["op2_pii"](ship, folder).toPandas()
        assert Counter(got.base_sha256) == Counter(hashlib.sha256(base_spans(t).encode()).hexdigest() for t in texts)


def test_pii_terms_that_give_an_entity_away(ship):
    rows = [(i, f"{w} Zarquon writes from bob@example.com {w} today about the weather {i}") for i, w in enumerate("red green blue white black pink".split())]
    rows += [(100 + i, f"the weather is fine today and {i} people like it") for i in range(200)]
    df = ship.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["pii_terms"] for r in pii.find(df).collect()}
    assert [s["value"] for s in got[0] if s["value"] == "Zarquon"] == ["Zarquon"]
    assert not any(s["value"] in ("today", "weather") for r in got.values() for s in r) and not got[150]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zarquon" not in clean[0] and "bob@" not in clean[0] and "<EMAIL>" in clean[0] and clean[150] == rows[56][1]


def test_pii_terms_of_rare_entities(ship):
    """One text in common is enough among many texts, at whatever distance; words that others have, or that meet by chance, stay."""
    far = "the weather is fine today " * 10
    rows = [(i, f"the weather is fine today and {i} people like it") for i in range(1100)]
    rows += [(2000, f"Zarquon {far} call bob@example.com"), (2001, "only the weather ann@example.com")]
    rows += [(3000 + i, f"often eve@example.com {w} weather") for i, w in enumerate("red green blue".split())]
    got = {r["doc_id"]: [s["value"] for s in r["pii_terms"]] for r in pii.find(ship.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2000] == ["Zarquon", "call"] and got[2001] == ["only"] and got[3000] == ["often"]
    assert not any(got[i] for i in range(1100))


def test_added_columns_and_input_columns_of_their_names(ship, docs):
    clash = docs.selectExpr("*", *[f"'x{i}' AS {c}" for i, c in enumerate("pii_base pii_terms pii_gone __copies copies copy key terms".split())])
    rest = clash.columns[4:]
    for got in (pii.sanitise(clash), mixing.mixed(clash)):
        assert got.columns == clash.columns and all(tuple(r[c] for c in rest) == tuple(f"x{i}" for i in range(len(rest))) for r in got.collect())
    assert pii.find(clash).filter("pii_base IS NULL").isEmpty()


def test_pii_of_long_texts(ship):
    """A megabyte of matches, valid or not, is read in seconds."""
    import time

    emails = " ".join(f"u{i}@example.com" for i in range(50_000))
    texts = ["12,34," * 170_000, emails, "4111 1111 1111 1111, " * 40_000]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.sanitise(ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == " ".join(["<EMAIL>"] * 50_000) and got[2]["text"] == "<CARD>, " * 40_000
    spans = {r["doc_id"]: r["pii_base"] for r in pii.find(ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in spans[1]] == [m.span() for m in re.finditer(r"\S+", emails)] and len(spans[2]) == 40_000
    assert time.time() - began < 120


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def components_by_force(rows, n, share=80):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_minhash_components(ship, tables, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    want = Counter(components_by_force(rows, 4))
    got = queries.QUERIES["op4_minhash"](ship, tables["corpus"]).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_forest_of_a_dense_region():
    """Hub, neighbours and peeling link every near pair of a region larger than SMALL to one component, without all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, minhash.SKETCH).astype(np.uint8)
    m = 400
    sketches = np.repeat(base[None], m, 0)
    change = rng.random(sketches.shape) < 0.18  # near the base, but less alike among themselves
    change[0] = False
    sketches[change] = rng.integers(0, 256, change.sum())
    keys = np.zeros((m, minhash.DEPTH), np.uint16)
    pairs = minhash.region_pairs(keys, sketches)
    parent = list(range(m))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j, _ in pairs:
        parent[find(i)] = find(j)
    near = [j for j in range(m) if (sketches[j] == base).mean() >= 0.8]
    assert len(near) > m / 2 and len({find(j) for j in near}) == 1
    assert len(pairs) == len({p[:2] for p in pairs}) < 20 * m and sum(t == 1 for _, _, t in pairs) < 8 * m


def test_least_likeness_of_sketches():
    """A pair of similarity 0.8 falls below it with probability MISS at most; a pair just at it is a candidate."""
    p = 0.8 + 0.2 / 16
    least = round(minhash.least_alike(8, 10) * minhash.SKETCH)
    below = sum(math.comb(minhash.SKETCH, k) * p**k * (1 - p) ** (minhash.SKETCH - k) for k in range(least))
    assert 0 < below <= minhash.MISS and minhash.least_alike(8, 10, 0) == 0 and minhash.least_alike(6, 10) < minhash.least_alike(8, 10)
    sketches = np.zeros((2, minhash.SKETCH), np.uint8)
    sketches[1, least:] = 1
    assert [q[:2] for q in minhash.region_pairs(np.zeros((2, minhash.DEPTH), np.uint16), sketches)] == [(0, 1)]


def test_region_links_against_force():
    """Whole and cut lists: what joins components by force is found, with few pairs."""
    rng = np.random.default_rng(8)
    for base_size, changes, most in ((60, 14, 500), (3000, 600, 2000)):
        base = rng.integers(0, 1 << 62, base_size, dtype=np.uint64)
        sets = []
        for _ in range(100):
            s = base.copy()
            at = rng.random(base_size) < rng.random() * changes / base_size
            s[at] = rng.integers(0, 1 << 62, at.sum(), dtype=np.uint64)
            sets.append(np.unique(s))
        like = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
        labels = np.arange(100)
        labels[1:40:2] = 0
        hashes = [np.frombuffer(minhash.bottom(s)[0], np.uint32) for s in sets]
        got = minhash.region_links(hashes, np.array([len(s) for s in sets]), labels, 8, 10)
        good = [(i, j) for i, j in got if like[i, j] >= 0.8]
        parts = lambda links: minhash.joins(labels, np.array([i for i, _ in links]), np.array([j for _, j in links]))[1]
        force = parts([tuple(x) for x in np.argwhere(like >= 0.8) if x[0] != x[1]])
        assert (parts(good) == force).all() and len(got) < most


def test_words_of_equal_polynomials_differ(ship, tmp_path):
    """Words that every polynomial hash modulo a power of two takes for equal are different words."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, " ".join([a] * 6)), (2, " ".join([b] * 6)), (3, " ".join([a] * 6).upper())]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(ship.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_words_of_long_texts_in_blocks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcDEF", k=rng.randint(1, 12))) for _ in range(400_000)) + "x" * 3_000_000 + "\t" + "end  \n"
    raw = text.encode()
    assert len(raw) > 2 * minhash.BLOCK
    assert minhash.word_hashes(raw).tolist() == [minhash._words[w] for w in raw.lower().split()]


@pytest.mark.parametrize("large", [2048, 40])
def test_minhash_of_large_regions(ship, monkeypatch, large):
    """Regions that are gathered and regions that are joined by first shingles give the same components."""
    monkeypatch.setattr(minhash, "LARGE", large)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base, rows = [word() for _ in range(120)], []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            w[at] = word()
        rows.append((i, " ".join(w)))
    docs = ship.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=5).select("doc_id", "component_id").collect()}
    assert got == {i: c for i, _, c in components_by_force(rows, 5)}


def test_minhash_links_within_a_crowd(ship):
    """Alike pairs among hundreds of documents of one template, none of them alike to a hub."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    base, rows = [word() for _ in range(200)], []
    for _ in range(600):
        places = rng.sample(range(4, 196, 6), 12)
        pair = list(base)
        for at in places[:8]:
            pair[at] = word()
        for own in (places[8:10], places[10:]):
            w = list(pair)
            for at in own:
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    docs = ship.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=5).select("doc_id", "component_id").collect()}
    assert got == {i: c for i, _, c in components_by_force(rows, 5)}
    assert len(set(got.values())) == 600


def test_language(ship, tables, corpus):
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in queries.QUERIES["op5_language"](ship, tables["corpus"]).collect()}
    for d, text, _, _ in corpus:
        held = d is not None and zlib.crc32(str(d).encode()) % 4 == 2
        pred, score = got[(d, held)] if d is not None else (None, 0)
        assert 0 <= score <= 1 and (d is None or (pred == "und") == (not any(c.isalpha() for c in text or "")))


def test_language_accuracy(ship):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the driver's tables are not here")
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in ship.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.QUERIES["op5_language"](ship, folder).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.98


def parsed_by_force(sample, text):
    """Phrases of a text: each the longest substring of the sample; a symbol that the sample lacks ends one."""
    count, held = 0, ""
    for c in text:
        if held + c in sample:
            held += c
        else:
            count += 1
            held = c if c in sample else ""
    return count


def test_phrases_against_force():
    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    samples = {"a": [draw("abc ", 900), "abab" * 100], "b": [draw("bcdé ", 700)], "c": ["\u4e00\u4e8c" * 200]}
    texts = [draw("abc ", k) for k in (1, 5, 255, 256, 257, 700, 3000)] + [draw("bcdxé .", 900), samples["a"][0] * 3, "abab" * 300, samples["b"][0][3:600] + "zz" + samples["b"][0], "", ". .", "\u4e00" * 600]
    model = language.Model(samples)
    plain = lambda t: re.sub(r"[^a-z\u00e9\u4e00\u4e8c]+", " ", t)
    n, got = language.phrases(model, texts)
    for j, lang in enumerate(model.langs):
        joined = plain("\0".join(samples[lang]))
        assert got[:, j].tolist() == [parsed_by_force(joined, plain(t)) if any(c.isalpha() for c in t) else 0 for t in texts]
    assert n.tolist() == [len(plain(t)) if any(c.isalpha() for c in t) else 0 for t in texts]


def test_languages_of_large_scripts(ship):
    """Two languages of 2,000 letters each, of which every letter tells them apart."""
    rng = random.Random(10)
    letters = {"xx": [chr(0x4E00 + i) for i in range(2000)], "yy": [chr(0xAC00 + i) for i in range(2000)]}
    rows = [(i, "".join(rng.choices(letters[k], k=300)), k) for i, k in enumerate(["xx", "yy"] * 150)]
    got = language.identify(ship.createDataFrame(rows, "doc_id long, text string, lang string"), language.sample(ship.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(r["lang"] == r["lang_pred"] for r in got.collect())


def test_language_sample_counts_copies_once(ship):
    rng = random.Random(10)
    prose = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(60))
    hot = prose("abcd")
    texts = [(hot, "aa")] * 8000 + [(prose("abcd"), "aa") for _ in range(40)] + [(prose("defg"), "bb") for _ in range(40)]
    df = ship.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string")
    got = language.sample(df, chars=4000, piece=300)
    assert set(got) == {"aa", "bb"} and all(3000 <= sum(map(len, v)) <= 4000 and len(set(v)) == len(v) for v in got.values())
    assert any(not any(t.startswith(p) for t, _ in texts) for p in got["bb"])


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    states = language.suffix_automaton(text)

    def accepts(w):
        s = 0
        for c in w:
            if c not in states[s]:
                return False
            s = states[s][c]
        return True

    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    import itertools

    for n in range(5):
        for w in itertools.product((1, 2, 3), repeat=n):
            assert accepts(w) == (w in subs)


def test_mixing(ship, tables, corpus):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables['corpus']}/documents.parquet/*.parquet'")
    rows = queries.QUERIES["op6_mixing"](ship, tables["corpus"]).toPandas()
    want = con.execute(mixing.ORACLE).df()
    cols = sorted(rows.columns)
    plain = lambda f: sorted((tuple(None if v != v else round(float(v), 6) for v in r) for r in f[cols].astype(object).fillna(np.nan).itertuples(index=False)), key=repr)
    assert plain(rows) == plain(want)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus)
    assert rows.drop_duplicates("source_size").target.sum() == pytest.approx(1.5 * total) and (rows.taken <= 2 * rows["size"]).all()
    assert mixing.mixed(ship.read.parquet(f"{tables['corpus']}/documents.parquet")).count() == rows.copies.sum()


def test_tiff_round_trip(ship, tables, corpus):
    got = queries.QUERIES["op8_tiff"](ship, tables["corpus"]).collect()
    by = defaultdict(set)
    for _, t, _, _ in corpus:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        by[(len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))].add(t)
    assert {tuple(r)[1:5] for r in got} == set(by)


@pytest.mark.parametrize("codec", sorted(tiff.CODECS))
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_codecs(codec, tile, order):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, k, (37, 50, s), dtype=np.uint8) for k, s in ((256, 1), (3, 3), (2, 4))] + [np.zeros((100, 300, 3), np.uint8)]
    for predictor in (1, 2):
        got = [px for _, px in tiff.pages(tiff.write(images, codec, predictor, 7, tile, order))]
        assert all((a == b).all() for a, b in zip(images, got, strict=True))


def test_tiff_pages_and_errors(ship):
    media = tiff.write([np.full((4, 4, 3), i, np.uint8) for i in range(3)])
    loop = bytearray(media)
    loop[-4:] = media[4:8]
    rows = [("a", bytearray(media)), ("b", bytearray(b"no")), ("c", None), ("d", bytearray(media[:-40])), ("e", loop)]
    got = tiff.decode(ship.createDataFrame(rows, "k string, content binary"), "k").collect()
    assert sorted((r["k"], r["page"]) for r in got if r["page"] is not None and r["k"] != "d") == [("a", 0), ("a", 1), ("a", 2), ("e", 0), ("e", 1), ("e", 2)]
    assert {r["k"] for r in got if r["error"]} == {"b", "d", "e"}


def removed_by_force(texts, length=200):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                hit[p] += 1
                hit[p + length] -= 1
        mask = np.cumsum(hit)[: len(t)] > 0
        edges = np.diff(np.concatenate(([0], mask.astype(int), [0])))
        out.append((len(t), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats(ship, tables, corpus, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    got = queries.QUERIES["op9_repeats"](ship, tables["corpus"]).collect()
    want = removed_by_force([(r[1] or "").encode() for r in corpus])
    assert Counter(tuple(r)[1:] if r.__fields__[0] == "doc_id" else None for r in got) == Counter(want)


def test_windows_of_equal_polynomials_differ(ship, tmp_path):
    """Strings of 200 bytes that every polynomial hash modulo 2**64 takes for equal are no repeats of each other."""
    sign = np.array([1])
    for d in (64, 32, 32, 16, 16, 8, 8, 4, 4, 2, 2, 1, 2, 2):
        sign = np.concatenate([np.zeros(d, int), sign]) - np.concatenate([sign, np.zeros(d, int)])
    sign = np.append(sign, np.zeros(200 - len(sign), int))
    a, b = (bytes((33 + np.maximum(x, 0)).tolist()) for x in (sign, -sign))
    assert len(a) == len(b) == 200 and a != b and SpanHash(np.frombuffer(a, np.uint8)).windows(200) == SpanHash(np.frombuffer(b, np.uint8)).windows(200)
    texts = [a.decode(), b.decode(), "y" * 150 + a.decode()[:40]]
    ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op9_repeats"](ship, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_force([t.encode() for t in texts])


def test_repeats_of_long_texts_in_blocks():
    """Blocks give the windows of a whole text, each once."""
    import pyarrow as pa

    text = "".join(random.Random(3).choices("abc", k=repeats.BLOCK + 1000))
    owned = []
    for rows, data, offsets, start in repeats.text_blocks(pa.RecordBatch.from_arrays([pa.array([text, "short"])], names=["text"])):
        assert len(data) <= repeats.BLOCK + repeats.LENGTH
        a = repeats.Anchors(data, offsets)
        owned += [(int(rows[d]), x) for d, low, n in zip(a.doc, a.low, a.count, strict=True) for x in range(start + low, start + low + n)]
    assert owned == [(0, x) for x in range(len(text) - repeats.LENGTH + 1)]


def test_repeats_of_periodic_and_overlapping_texts(ship, tmp_path):
    import random

    rng = random.Random(5)
    parts = ["".join(rng.choices("ab", k=rng.randint(150, 600))) for _ in range(10)]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)] + ["a" * 3000, "ab" * 700, "é" * 250, "a" * 199, "c" * 200]
    ship.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op9_repeats"](ship, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_force([t.encode() for t in texts])


def test_maximal_repeats_against_force():
    text = b"abcabxabcabyabcab"
    symbols = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    sa = repeats.SuffixArray(symbols, np.arange(len(text)), len(text))
    before = np.where(sa.order == 0, -1, symbols[np.maximum(sa.order - 1, 0)])
    got = {(text[sa.order[a] : sa.order[a] + n], tuple(sorted(sa.order[a : b + 1].tolist()))) for n, a, b in repeats.maximal_repeats(sa.order, sa.common, before, 2)}
    want = set()
    for n in range(2, len(text)):
        for i in range(len(text) - n + 1):
            at = [j for j in range(len(text) - n + 1) if text[j : j + n] == text[i : i + n]]
            left, right = {text[j - 1 : j] if j else None for j in at}, {text[j + n : j + n + 1] or j for j in at}
            if len(at) > 1 and (len(left) > 1) and len(right) > 1:
                want.add((text[i : i + n], tuple(at)))
    assert got == want


def test_fingerprints(ship, tables, corpus):
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        n, nxt = len(t), rows[(i + 1) % len(rows)][1]
        edited = t[: n - n // 2] + nxt[: n // 2]
        want.append((d, n, hashlib.sha256(edited.encode()).hexdigest()))
    got = queries.QUERIES["op10_fingerprint"](ship, tables["corpus"]).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    by_text = defaultdict(set)
    ids = {r[0]: r[1] or "" for r in corpus if r[0] is not None}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            by_text[ids[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_of_any_ids(ship, tmp_path):
    """String ids, one of them on half of the rows, and rows without an id."""
    rng = random.Random(4)
    rows = [(rng.choice([None, "a:b", "é", "Z", f"k{i % 9}", "hot", "hot", "hot"]), "".join(rng.choices("abc ", k=rng.randint(0, 40)))) for i in range(300)]
    docs = ship.createDataFrame(rows, "doc_id string, text string")
    order = sorted(rows, key=lambda r: r[1])
    order = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        f = edit_embedding.fingerprints([t, edited, nxt])
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f[0].tobytes().hex(), f[1].tobytes().hex(), (f[0] == f[1]).mean(), (f[0] == f[2]).mean())] += 1
    assert Counter(tuple(r) for r in edit_embedding.compare_edited(docs.repartition(5)).collect()) == want


def test_edit_embedding_follows_edits(words):
    import random

    rng = random.Random(6)
    text = " ".join(rng.choices(words, k=800))
    cut = len(text) // 2
    f = edit_embedding.fingerprints([text, text[:cut] + "xyz" + text[cut:], text[:50] + text[53:], text[:cut], " ".join(rng.choices(words, k=800))])
    like = (f == f[0]).mean(axis=1)
    assert like[1] > 0.85 and like[2] > 0.8 and 0.3 < like[3] < 0.7 and like[4] < 0.1


@pytest.mark.parametrize("most", [2048, 8])
def test_near_components_against_force(ship, most):
    """Every alike pair is found, in ordinary buckets and in crowded ones; copies share a class."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, edit_embedding.SAMPLES), dtype=np.uint8)
    prints = []
    for i in range(240):
        f = base[i % 6].copy()
        at = rng.choice(edit_embedding.SAMPLES, rng.integers(0, 34 if i % 6 else 5), replace=False)
        f[at] = rng.integers(0, 256, len(at))
        prints += [f] * (1 + (i % 50 == 0))
    prints = np.array(prints)
    like = (prints[:, None] == prints[None]).mean(axis=2) >= 0.8
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        new = np.array([label[like[i]].min() for i in range(len(prints))])
        if (new == label).all():
            break
        label = new
    df = ship.createDataFrame([(i, f.tobytes().hex()) for i, f in enumerate(prints)] + [(9999, None)], "doc_id long, fingerprint string")
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in edit_embedding.near_components(df, 0.8, most).collect()}
    same = {f.tobytes(): i for i, f in reversed(list(enumerate(prints)))}
    assert got.pop(9999) == (None, None) and got == {i: (same[f.tobytes()], label[i]) for i, f in enumerate(prints)}
    assert len(edit_embedding.bands(0.8)) == 26 and sum(n for _, n in edit_embedding.bands(0.8)) == edit_embedding.SAMPLES


def test_features_against_force():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40):
        payload = rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() if n != 3 else b"ab " * 192
        px = np.frombuffer(payload, np.uint8).reshape(n, 64, 3)
        counts = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in counts.values())
        means = [sum(payload[k::3]) / (64 * n) for k in range(3)]
        want = f"mean={means[0]:.3f}:{means[1]:.3f}:{means[2]:.3f};entropy={entropy:.4f};"
        got = tiff.features(px)
        assert got.startswith(want.replace("-0.0000", "0.0000")) or got.replace("-0.0000", "0.0000").startswith(want.replace("-0.0000", "0.0000"))
        assert len(got.split("gradient=")[1]) == 16
        media = tiff.store(payload)
        assert b"".join(p.tobytes() for _, p in tiff.pages(media)) == payload and media == tiff.store(payload)


def test_walk_equals_its_definition():
    steps, _ = edit_embedding.tables()
    classes = np.random.default_rng(2).integers(0, edit_embedding.CLASSES, 500)
    first, size = np.array([0, 120, 120, 470]), np.array([120, 0, 350, 30])
    got = edit_embedding.walk(classes, first, size)
    for f, n in zip(first, size, strict=True):
        t = 0
        for c in range(f, f + n):
            assert got[c] == t
            t += steps[classes[c] * edit_embedding.PERIOD + t % edit_embedding.PERIOD]


def test_pieces_equal_the_library(ship, tables, corpus):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    texts = [r[1] or "" for r in corpus] + ["  Hello  world\n\tx é <s>", "   ", " a", "a ", "😀 中文 thé ▁a", " " * 40 + "x" + " " * 33, "aaaa" * 500, "a\x00b", "ab　c d", "http://www.example.com/?x=1&y=2"]
    p = pieces.loaded(pieces.read_model())
    flat, ends = p.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:], strict=False):
        assert flat[a:b].tolist() == lib.encode(t) and p.decode(flat[a:b]) == lib.decode(lib.encode(t))
    got = queries.QUERIES["op3_sentencepiece"](ship, tables["corpus"]).collect()
    assert all(r["round_trip"] for r in got) and sum(r["n_tokens"] for r in got) == sum(len(lib.encode(r[1] or "")) for r in corpus)
    back = pieces.decode(pieces.encode(ship.createDataFrame([(1, "a b  c"), (2, None)], "doc_id long, text string"))).collect()
    assert [r["decoded"] for r in back] == ["a b  c", ""]
