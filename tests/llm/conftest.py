import random

import pytest


@pytest.fixture(scope="session")
def ship(spark):
    from strandline.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text, lang, source): near and exact copies, shared passages, nulls, empties, ties and personal data."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, passage = [], prose(60)
    for i in range(60):
        rows.append((i, prose(rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{i % 4}"))
    base = prose(150)
    for i in range(60, 75):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s0"))
    for i in range(75, 80):
        rows.append((i, base, "en", "s0"))
    for i in range(80, 86):
        rows.append((i, prose(20) + " " + passage + "\n" + prose(20), "de", None))
    rows += [(86, None, "en", "s1"), (87, "", None, "s2"), (88, "  \n", "en", "s2"), (89, "One Two", "en", "s3"), (90, "one two", None, "s3"), (91, "x" * 3000, "en", "s3")]
    rows += [(92, "mail bob@example.com, card 4111 1111 1111 1111, ip 10.0.0.1, call +1 (555) 123-4567.", "en", "s1"), (93, "ünïcödé 😀 a@b.co", "de", "s1")]
    rows += [(60, rows[60][1], "en", "s0"), (None, "no id at all here", "en", "s1"), (None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(ship, corpus):
    return ship.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def empty(ship):
    return ship.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(ship, docs, empty, tmp_path_factory):
    """Folders with a documents table: the corpus, none of it, and the corpus with further columns of clashing names."""
    from pyspark.sql import functions as F

    out = {}
    clash = docs.withColumns({c: F.lit("x") for c in "size hash score lang_pred component_id cls key ids n_tokens copies edge spans bucket last n_chars".split()})
    for name, df in (("corpus", docs), ("empty", empty), ("clash", clash)):
        out[name] = str(tmp_path_factory.mktemp(name))
        df.write.mode("overwrite").parquet(f"{out[name]}/documents.parquet")
    return out
