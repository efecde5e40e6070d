"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base patterns (email, ip, card, phone) are the protected entities.  The other
words of an entity's texts are candidate quasi-identifiers: over the whole corpus, a
term's disclosure is its pointwise mutual information with an entity as a
share of the entity's own information content,

    r(t, c) = log2(n(c,t) N / (n(c) n(t))) / log2(N / n(c)),

which is 1 where the term only ever occurs in that entity's texts.  Terms whose
r reaches ``generalise_at`` are replaced by a placeholder wherever they occur
in the corpus, and removed outright from ``remove_at`` on, unless chance alone
would bring term and entity together so often: the chance that n(c,t) or more
of n(t) texts drawn from N fall among the n(c) is 2 ** -bits at most, with

    bits = n(t) KL(n(c,t) / n(t) || n(c) / N),

and has to be 2 ** -``SIGNIFICANT`` or less.  Among 2 ** ``SIGNIFICANT`` texts
or more a single text in common is enough where term and entity occur once.

Defined results: a null text counts as empty and has no spans; rows are
independent of ``doc_id``, so null or repeated ids are fine; ties in start are
ordered by kind; columns that ``find`` adds replace input columns of their
names, and ``sanitise`` leaves all columns but the text as they are, whatever
their names; an empty table gives an empty result.

Spans are found row by row: ``split`` yields the gaps between the matches that
``regexp_extract_all`` yields, so running lengths give code-point offsets with
no limit on a text's length.  The patterns are possessive and anchored to the
start of a run (or to the end of the previous match), which keeps each scan
linear in the text.  Matches are gathered, and texts are put together again,
CHUNK spans at a time, so that a text of very many matches is not copied once
for each of them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, table

KINDS = ("email", "ip", "card", "phone", "term")
#: kind, pattern, characters without which a text has no match
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SIGNIFICANT = 10
GENERALISE_AT, REMOVE_AT = 0.9, 0.97
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Spans that are gathered at a time.
CHUNK = 128


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[^0-9]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, r"[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; within a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunked(items: Column, at: Column, kind: str, step, gather, finish) -> Column:
    """Fold an array: ``step(acc, item, extra)`` over chunks, whose results ``gather`` turns into one item of the outer array.

    acc is (at, out): where the fold stands and what the chunk has given so far.
    """
    empty = F.array().cast(f"array<{kind}>")
    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))

    def chunk(acc: Column, c: Column) -> Column:
        own = F.slice(items, c * CHUNK + 1, F.lit(CHUNK))
        return gather(acc, own, lambda begin, extra, join: F.aggregate(own, F.struct(begin.alias("at"), empty.alias("out")), lambda a, x: step(a, x, extra), join))

    outer = F.array().cast("array<string>" if kind == "string" else f"array<array<{kind}>>")
    return F.when(F.size(items) > 0, F.aggregate(chunks, F.struct(at.alias("at"), outer.alias("out")), chunk, finish))


def _spans(text: Column, pattern: Column, number: int, valid=None) -> Column:
    """All matches of a pattern as (start, end, kind, value) that are valid; ends are exclusive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))

    def step(acc: Column, x: Column, _) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value"))
        more = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (F.when(valid(x["value"]), more).otherwise(acc["out"]) if valid else more).alias("out"))

    def gather(acc: Column, own: Column, fold) -> Column:
        return fold(acc["at"], None, lambda inner: F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out")))

    spans = lambda e: _chunked(e, F.lit(0), SPAN.removeprefix("array<").removesuffix(">"), step, gather, lambda acc: F.flatten(acc["out"]))
    return F.coalesce(_bound(each, spans), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The base matches of a non-null text, by start and then kind."""
    none = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    kinds = []
    for i, (kind, pattern, needs) in enumerate(PATTERNS):
        there = F.contains(text, F.lit(needs)) if needs else digit
        if kind != "email" and needs:
            there = there & digit
        hits = _spans(text, F.lit(pattern), i, partial(_valid, kind) if kind != "email" else None)
        kinds.append(F.when(there, hits).otherwise(none))
    return F.array_sort(F.concat(*kinds))


def term_spans(text: Column, terms: Column) -> Column:
    """Occurrences of the given lower-case terms as whole words."""
    words = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(terms) > 0, _spans(text, words, len(PATTERNS))).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _disclosure(n: int, n_t: Column) -> Column:
    """r(t, c) from the columns n_ct and n_c, for n texts of which n_t have the term."""
    texts = F.lit(float(n))
    return F.log2(F.col("n_ct") * texts / (F.col("n_c") * n_t)) / F.log2(texts / F.col("n_c"))


def _bits(n: int, n_t: Column) -> Column:
    """How unlikely n_ct of n_t texts among the n_c of n are by chance; falls as n_t grows."""
    p, q = F.col("n_c") / F.lit(float(n)), F.col("n_ct") / n_t
    rest = F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, n_t * (q * F.log2(q / p) + rest)).otherwise(0.0)


def disclosures(docs: DataFrame, significant: float = SIGNIFICANT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """Per text with terms that give an entity away: key, doc_id, terms, gone.

    ``docs`` has doc_id and a non-null text.  ``terms`` are all of a text's
    terms with r >= generalise_at that are significant, ``gone`` those with r >= REMOVE_AT.
    """
    n = docs.select(F.xxhash64("text")).distinct().count()
    if not n:
        return docs.select("doc_id", F.xxhash64("text").alias("key"), F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("gone"))
    held = docs.filter(F.col("text").rlike("[0-9@]")).select("text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    # what is left without the entities, of the words that the text itself has
    other = sanitised(F.col("text"), F.col("spans"), F.array().cast("array<string>"), [" "] * len(KINDS))
    other = F.array_intersect(_terms(other), _terms(F.col("text")))
    entity = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.when(s["kind"].isin(2, 3), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"])))
    near = materialize(
        held.select(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(entity(s)))).alias("entities"), F.xxhash64("text").alias("key"), other.alias("terms")).dropDuplicates(["key"]), "pii-near"
    )
    n_c = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    beside = near.select("entities", F.explode("terms").alias("term")).select("term", F.explode("entities").alias("entity"))
    pairs = beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).join(n_c.filter(F.col("n_c") < n), "entity")
    # a term occurs in at least as many texts as it shares with entities, which bounds r and bits from above:
    # words of all sorts of entities' texts are out before any text is searched for them
    n_least = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    least = F.col("n_least")
    pairs = pairs.join(n_least, "term").filter((_disclosure(n, least) >= generalise_at) & (_bits(n, least) >= significant)).drop("n_least")
    pairs = materialize(pairs, "pii-pairs", thin=True)
    # occurrences of the candidate terms in all texts: the candidates are a written table, so
    # Spark broadcasts them only where their size is under its threshold and shuffles otherwise
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(_terms(F.col("text"))).alias("term"))
    hits = materialize(words.join(pairs.select("term").distinct(), "term", "left_semi"), "pii-hits")
    n_t = hits.select("key", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    flagged = pairs.join(n_t, "term").filter(_bits(n, F.col("n_t")) >= significant).groupBy("term").agg(F.max(_disclosure(n, F.col("n_t"))).alias("r")).filter(F.col("r") >= generalise_at)
    flagged = materialize(flagged, "pii-terms", thin=True)
    found = hits.join(flagged, "term").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.sort_array(F.collect_set(F.when(F.col("r") >= REMOVE_AT, F.col("term")))).alias("gone")
    )
    return materialize(found, "pii-found", thin=True)


def find(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) plus pii_base, pii_terms (spans) and pii_gone."""
    return _with_spans(docs.drop("pii_base", "pii_terms", "pii_gone"), "pii_base", "pii_terms", "pii_gone")


def _with_spans(docs: DataFrame, base: str, terms: str, gone: str) -> DataFrame:
    found = disclosures(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    d, t = docs.alias("d"), found.alias("t")
    text = F.coalesce(F.col("d.text"), F.lit(""))
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.xxhash64(text) == F.col("t.key"))
    own = F.coalesce(F.col("t.terms"), F.array().cast("array<string>"))
    return d.join(t, on, "left").select("d.*", base_spans(text).alias(base), term_spans(text, own).alias(terms), F.col("t.gone").alias(gone))


def sanitised(text: Column, spans: Column, gone: Column, placeholders: list[str] | None = None) -> Column:
    """The text with each span replaced by its kind's placeholder, or cut where it is to go.

    Where spans overlap the one that starts first is replaced and what the
    others have beyond it is cut.
    """
    marks = F.array(*map(F.lit, placeholders or [f"<{k.upper()}>" for k in KINDS]))

    def whole(v: Column) -> Column:
        def step(acc: Column, s: Column, near: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            dropped = (s["kind"] == len(PATTERNS)) & F.array_contains(v["gone"], F.lower(s["value"]))
            before = F.substring(near["text"], acc["at"] - near["at"] + 1, s["start"] - acc["at"])
            piece = F.concat(before, F.when(dropped, F.lit("")).otherwise(F.get(marks, s["kind"])))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.when(fresh, piece).otherwise(F.lit("")))).alias("out"))

        def gather(acc: Column, own: Column, fold) -> Column:
            # what lies around the chunk's spans is cut out of the text once
            until = F.array_max(F.transform(own, lambda s: s["end"]))
            near = F.struct(acc["at"].alias("at"), F.substring(v["text"], acc["at"] + 1, F.greatest(until - acc["at"], F.lit(0))).alias("text"))
            join = lambda inner: F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(inner["out"], ""))).alias("out"))
            return _bound(near, lambda n: fold(acc["at"], n, join))

        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(v["text"], acc["at"] + 1, F.length(v["text"])))
        return _chunked(v["spans"], F.lit(0), "string", step, gather, end)

    return F.when(F.size(spans) > 0, _bound(F.struct(text.alias("text"), spans.alias("spans"), gone.alias("gone")), whole)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """The same columns, with the text sanitised; a null text stays null."""
    names = [free_name(docs, n) for n in ("pii_base", "pii_terms", "pii_gone")]
    out = _with_spans(docs, *names)
    base, terms, gone = map(F.col, names)
    new = sanitised(F.col("text"), F.array_sort(F.concat(base, terms)), F.coalesce(gone, F.array().cast("array<string>")))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), new)).drop(*names)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(len(PATTERNS))],
        F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("pii_base", "pii_terms"))).alias("spans"),
    )
