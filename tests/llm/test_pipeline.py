"""The pipeline against brute force, stage by stage and as a whole."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from strandline.llm import mixing, pieces
from test_documents import base_spans, components_by_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(ship, tables):
    """The rows before the first stage and after each, written and read again as the driver does."""
    from pyspark.sql import functions as F

    folder = tables["corpus"]
    docs = ship.read.parquet(f"{folder}/documents.parquet").withColumn("n_chars", F.length("text").cast("long"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(ship, out[-1], folder).write.mode("overwrite").parquet(path)
        out.append(ship.read.parquet(path))
    return out


def rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5 and stages[-1].columns == [*COLUMNS, "n_tokens", "ids", "round_trip"]


def test_language_stage(stages):
    want = [r for r in rows(stages[0]) if any(c.isalpha() for c in r[1] or "")]
    assert Counter(rows(stages[1])) == Counter(want)


def test_near_dedup_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    parts = components_by_force([r[:2] for r in before], 5)
    assert Counter(r[0] for r in after) == Counter({c: 1 for _, _, c in parts}) and set(after) <= set(before)


def test_near_dedup_decides_by_id_and_text(ship):
    """A text that shares its doc_id with a copy of another document stays; rows with equal ids and texts are one."""
    base = " ".join(f"w{i}" for i in range(60))
    near, unique = base + " more", " ".join(f"u{i}" for i in range(50))
    data = [(3, base, "en", "s", 1), (7, unique, "en", "s", 1), (7, near, "en", "s", 1), (7, unique, "de", "t", 2), (None, unique + " too", None, None, None), (8, None, "en", "s", 0), (9, "  ", None, "s", 0)]
    docs = ship.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(rows(corpus_pipeline.drop_near_duplicates(ship, docs, "")))
    assert got == Counter([data[0], data[3], data[5], data[6]]) or got == Counter([data[0], data[1], data[5], data[6]])
    clash = docs.selectExpr("*", "1 AS text_key", "2 AS first", "3 AS cls")
    assert corpus_pipeline.drop_near_duplicates(ship, clash, "").count() == 4


def test_pii_stage(stages):
    after = {r[0]: r for r in rows(stages[3])}
    for d, text, *_ in rows(stages[2]):
        want, at = "", 0
        for span in filter(None, base_spans(text).split(",")):
            kind, a, b = span.split(":")
            if int(a) >= at:
                want += text[at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        want += text[at:]
        assert after[d][1] == want and after[d][4] == len(want)


def test_mixing_stage(stages, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables['corpus']}/pii/*.parquet'")
    copies = con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()
    want = Counter()
    for d, n in copies:
        want[d] += n
    assert Counter(r[0] for r in rows(stages[4])) == +want


def test_sentencepiece_stage(stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    for r in stages[5].collect():
        assert r["ids"] == lib.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_run_is_the_stages(ship, stages, tmp_path):
    stages[0].write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(ship, str(tmp_path))
    assert Counter(rows(got)) == Counter(rows(stages[5]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "pii", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(ship, tmp_path):
    ship.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(ship, str(tmp_path)).collect() == []
