"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text.  A text is parsed into phrases, each the longest match in the
automaton; a symbol that occurs nowhere in the sample ends a phrase.  The
language that needs the fewest phrases a symbol wins.  Symbols are letters, of
however many scripts, and runs of other characters; transitions lie in a hash
table a language, so its size follows the sample and not the alphabet.

Texts are cut into lanes of LANE symbols that advance together, one table
lookup a symbol and language.  Each lane is parsed from the root at first and
then again from the state in which the lane before it ends, until both parses
break at one place, behind which they are the same; so the result is that of
one parse of the whole text.

The sample is bounded by ``SAMPLE_CHARS`` a language, in pieces of
``PIECE_CHARS`` at most from texts and places picked by the texts' hashes, so it
does not depend on row order or partitioning and copies count once.

Defined results: null texts and texts without a letter are ``und`` with score
0; equal texts get equal results; ties go to the first language by code point;
without labelled rows every text is ``und``; a null doc_id is neither learned
from nor held out; the added columns replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, slices, table

SAMPLE_CHARS = 40_000
PIECE_CHARS = 4_000
LANE = 256
UND = "und"
SPACE = 0


def remainder(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def sample(docs: DataFrame, chars: int = SAMPLE_CHARS, piece: int = PIECE_CHARS) -> dict[str, list[str]]:
    """Language -> pieces of text; at most about ``chars`` each reach the driver's model."""
    labelled = docs.filter((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # copies are one text before anything is counted
    once = labelled.groupBy("lang", "h").agg(F.max(F.least(F.length("text"), F.lit(piece))).alias("n"))
    totals = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return {}
    # the hash threshold lets about four times the wanted text through, whatever the corpus holds
    share = [(k, min(1.0, 4 * chars / max(1, n))) for k, n in totals.items()]
    limit = F.create_map(*[x for k, p in share for x in (F.lit(k), F.lit(int(p * (2**62) - 1)))])
    # where a text's piece begins follows from its hash, too
    begin = F.pmod("h", F.greatest(F.length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    rows = (
        labelled.filter(F.shiftrightunsigned("h", 2) <= limit[F.col("lang")])
        .select("lang", "h", F.substring(F.col("text"), begin, F.lit(piece)).alias("piece"))
        .groupBy("lang", "h")
        .agg(F.min("piece").alias("piece"))
        .withColumn("before", F.sum(F.length("piece")).over(_by_hash()))
        .filter(F.col("before") - F.length("piece") < chars)
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        have = sum(map(len, out.setdefault(r["lang"], [])))
        if have < chars:
            out[r["lang"]].append(r["piece"][: chars - have])
    return out


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("h")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Transitions:
    """A state's successor by a symbol, from an open hash table; -1 where there is none."""

    def __init__(self, states: list[dict[int, int]], symbols: int):
        self.symbols = symbols
        keys = np.array([i * symbols + c for i, d in enumerate(states) for c in d], np.int64)
        to = np.array([t for d in states for t in d.values()], np.int32)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.to = np.full(self.mask + 1, -1, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)  # of those that want a free slot one gets it
            won = free[one]
            self.keys[slot[won]], self.to[slot[won]] = keys[won], to[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.root = self(np.zeros(symbols, np.int64), np.arange(symbols))
        self.root = np.maximum(self.root, 0).astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state * self.symbols + symbol
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.to[slot], -1)
        left = np.flatnonzero((have != key) & (have >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.mask
            have = self.keys[at]
            hit = have == key[left]
            out[left[hit]] = self.to[at[hit]]
            left = left[~hit & (have >= 0)]
        return out


class Model:
    """Alphabet and one automaton a language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        lowered = {k: "\0".join(samples[k]).lower() for k in self.langs}
        letters = sorted({c for t in lowered.values() for c in t if c.isalpha()})
        every = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.lut = np.where(every, len(letters) + 1, SPACE).astype(np.int32)  # a letter never seen breaks every match
        for i, c in enumerate(letters):
            self.lut[ord(c)] = i + 1
        self.pad = len(letters) + 2
        self.tables = [Transitions(suffix_automaton(squeeze(self.lut[code_points(lowered[k])]).tolist()), self.pad + 1) for k in self.langs]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(sym: np.ndarray) -> np.ndarray:
    """Runs of non-letters become one symbol."""
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE)
    return sym[keep]


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text (0: no letter) and phrases[text, language]."""
    parts = [squeeze(model.lut[code_points(t.lower())]) for t in texts]
    n = np.array([len(p) if p.any() else 0 for p in parts], np.int64)
    lanes = -(-n // LANE)
    first = np.concatenate(([0], np.cumsum(lanes)))
    flat = np.full(int(first[-1]) * LANE, model.pad, np.int64)
    for p, size, at in zip(parts, n, first[:-1], strict=True):
        flat[at * LANE : at * LANE + size] = p[:size]
    steps = np.ascontiguousarray(flat.reshape(-1, LANE).T)
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    there = np.flatnonzero(n)
    if not len(there):
        return n, out
    follows = np.ones(steps.shape[1], bool)
    follows[first[:-1][there]] = False
    for j, t in enumerate(model.tables):
        out[there, j] = np.add.reduceat(_breaks(t, steps, follows, model.pad), first[:-1][there])
    return n, out


def _breaks(table_: Transitions, steps: np.ndarray, follows: np.ndarray, pad: int) -> np.ndarray:
    """How many phrases end in each lane; ``follows``: whether a lane goes on where the one before it ends."""
    state = np.zeros(steps.shape[1], np.int64)
    ends = np.zeros(steps.shape, bool)
    for sym, end in zip(steps, ends, strict=True):
        to = table_(state, sym)
        np.less(to, 0, out=end)
        state = np.where(end, table_.root[sym], to)
    ends &= steps != pad
    count = ends.sum(axis=0)
    total, first = count.copy(), state.copy()
    # again from where the lane before ends, as long as that makes a difference
    lanes = np.flatnonzero(follows)
    while len(lanes):
        own = state[lanes - 1]
        new, extra = first[lanes], np.zeros(len(lanes), np.int64)
        active = np.flatnonzero(own != 0)
        own = own[active]
        for k in range(LANE):
            if not len(active):
                break
            sym = steps[k, lanes[active]]
            to = table_(own, sym)
            broke, before = (to < 0) & (sym != pad), ends[k, lanes[active]]
            extra[active] += broke.astype(np.int64) - before
            own = np.where(to < 0, table_.root[sym], to)
            open_ = ~(broke & before)
            active, own = active[open_], own[open_]
        new[active] = own
        count[lanes] = total[lanes] + extra
        other = new != state[lanes]
        changed = lanes[other]
        state[changed] = new[other]
        lanes = changed[changed + 1 < len(follows)] + 1
        lanes = lanes[follows[lanes]]
    return count


def identify(docs: DataFrame, samples: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(samples) if samples else None)  # a few MB a language and 4 MB, whatever the corpus holds
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    schema = T.StructType([docs.schema[c] for c in names] + new.fields)

    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            pred, score = [UND] * len(texts), np.zeros(len(texts))
            if m:
                n, counts = phrases(m, texts)
                best = counts.argmin(axis=1)
                low = np.sort(counts, axis=1)
                second = low[:, 1] if low.shape[1] > 1 else n
                ok = n > 0
                pred = [m.langs[b] if k else UND for b, k in zip(best, ok, strict=True)]
                score = np.where(ok, 1 - low[:, 0] / np.maximum(second, 1), 0.0).clip(0, 1)
            yield add_columns(
                batch, {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())},
                tuple(c for c in batch.schema.names if c not in names),
            )

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), sample(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
