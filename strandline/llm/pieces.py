"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together.  At each position the substrings that
start there are hashed and probed in the sorted keys of all piece beginnings;
a piece that continues the best path scores its end, and vectorised maxima
store the backpointers.

The model is a merge model (BPE with byte fallback), whose result is not the
path with the largest sum of scores.  It is the only path on which every two
neighbouring pieces encode to themselves, so an edge scores one if its piece
may follow the path's last piece and is closed otherwise; which pairs may
follow each other is found by merging the two and kept per process.

Defined results: null and empty texts have no ids and decode to an empty text;
U+2581 decodes to a space, as in the library; equal texts have equal ids; the
added columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX1, add_columns, mix64, powers, slices, table

#: The vocabulary file, unless the setting names another one.
MODEL, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.strandline.pieceModel"
#: Words whose ids a process keeps; the table starts afresh when it is full.
KEPT_WORDS = 700_000
#: Pairs of pieces whose merge a process remembers.
KEPT_PAIRS = 1_000_000
PAIR_BITS = 20
MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


class Pieces:
    """The tables of one model and the words and pairs seen so far by this process."""

    def __init__(self, proto: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = lib.get_piece_size()
        self.n, self.prefix = n, lib.encode("a", out_type=str)[0].startswith(MARK)
        self.normalise = lib.normalize if "Ａ" != lib.normalize("Ａ").strip(MARK + " ") else None
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.text = {i: lib.id_to_piece(i) for i in plain}
        self.rank = {self.text[i]: -lib.get_score(i) for i in plain}
        self.ids = {t: i for i, t in self.text.items()}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.byte = np.zeros(256, np.int32)
        out = [b""] * n
        for i in range(n):
            if lib.is_byte(i):
                b = int(lib.id_to_piece(i)[3:5], 16)
                self.byte[b] = i
                out[i] = bytes((b,))
        for i, t in self.text.items():
            out[i] = t.replace(MARK, " ").encode()
        self.bytes_of = out
        # keys of all beginnings of pieces, sorted; -1 where a beginning is no piece itself
        self.self_made = {t for t in self.ids if self.merge(t) == [t]}
        begins: dict[str, int] = {}
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                begins.setdefault(t[:k], -1)
            begins[t] = i if t in self.self_made else begins.get(t, -1)
        strings = list(begins)
        keys = np.array([int(self._hash(np.array([list(map(ord, t))], np.uint64).T).hash(0, len(t))[0]) for t in strings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([begins[t] for t in strings], np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        # where each character of the lower planes stands among the keys; -1 where it begins no piece
        points = np.arange(0x3000, dtype=np.uint64)[None]
        one = self._hash(points).hash(0, 1)
        at = np.minimum(np.searchsorted(self.keys, one), len(self.keys) - 1)
        self.lone = np.where(self.keys[at] == one, at, -1)
        self.longest = max(map(len, self.ids))
        # pairs seen so far: a direct-mapped memo before a dictionary
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.pairs: dict[int, bool] = {}
        self.fresh()

    def fresh(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def merge(self, text: str) -> list[str]:
        """Merge a string's characters, best piece first and leftmost among equals."""
        parts = list(text)
        rank = self.rank.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    class _hash:
        """Prefix hashes of columns of code points: one row a position, so that a step reads whole rows."""

        def __init__(self, points: np.ndarray):
            n = points.shape[0]
            self.sums = np.zeros((n + 1, points.shape[1]), np.uint64)
            np.cumsum(mix64(points * MIX1 + np.uint64(7)) * powers(BASE, n)[:, None], axis=0, out=self.sums[1:])
            self.inverse = powers(INVERSE, n + 1)

        def hash(self, start: int, end: int, rows=None) -> np.ndarray:
            a, b = self.sums[start], self.sums[end]
            return ((b - a) if rows is None else (b.take(rows) - a.take(rows))) * self.inverse[start]

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes to itself; left -1 is a word's start or an unknown character."""
        out = left < 0
        ask = np.flatnonzero(~out)
        if not len(ask):
            return out
        keys = left[ask].astype(np.int64) * self.n + right[ask]
        slot = (keys.view(np.uint64) * np.uint64(BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok.take(slot)
        new = np.flatnonzero(self.pair_keys.take(slot) != keys)
        if len(new):
            ok[new] = list(map(self._pair, keys[new].tolist()))
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = keys[new], ok[new]
        out[ask] = ok
        return out

    def _pair(self, key: int) -> bool:
        known = self.pairs.get(key)
        if known is None:
            a, b = self.text[key // self.n], self.text[key % self.n]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, length) by end position and word for words of one length; piece -1 marks an unknown character.

        ``points`` has a row for each position and a column for each word.
        """
        n, m = points.shape
        h = self._hash(points)
        score = np.full((n + 1, m), -1, np.int32)
        score[0] = 0
        piece, back = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)
        top, low = len(self.keys) - 1, bool((points < len(self.lone)).all())
        for s in range(n):
            rows, here, last = None, score[s], piece[s]
            for e in range(s + 1, min(n, s + self.longest) + 1):
                if e == s + 1 and low:
                    at = self.lone.take(points[s].astype(np.int64))
                    alive = at >= 0
                else:
                    key = h.hash(s, e, rows)
                    at = np.minimum(np.searchsorted(self.keys, key), top)
                    alive = self.keys.take(at) == key
                found = self.values.take(at)
                if e == s + 1:  # a character that is no piece stands alone
                    lone = np.flatnonzero(~alive | (found < 0))
                    if len(lone):
                        score[e][lone], back[e][lone] = here[lone] + 1, 1
                if not alive.all():
                    rows, found = (np.flatnonzero(alive) if rows is None else rows[alive]), found[alive]
                    if not len(rows):
                        break
                is_piece = found >= 0
                if rows is None:
                    rows = np.arange(m)
                r, f = rows[is_piece], found[is_piece]
                if not len(r):
                    continue
                ok = self.may_follow(last.take(r), f)
                r, f = r[ok], f[ok]
                new = here.take(r) + 1
                better = new > score[e].take(r)
                r = r[better]
                score[e][r], piece[e][r], back[e][r] = new[better], f[better], e - s
        return piece, back

    def learn(self, words: list[str]) -> None:
        """Add the ids of new words to the table."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, (1 << 19) // (n + 1))  # so a step's rows stay in the processor's cache
            for i in range(0, len(group), step):
                self._learn(group[i : i + step], n)

    def _learn(self, group: list[str], n: int) -> None:
        points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n)
        piece, back = self.viterbi(np.ascontiguousarray(points.T).astype(np.uint64))
        # walk back; each step yields one piece of every word that is not yet at its start
        at = np.full(len(group), n)
        rows, chunks = np.arange(len(group)), []
        while len(rows):
            chunks.append((rows, at[rows] - back[at[rows], rows], piece[at[rows], rows]))
            at[rows] = chunks[-1][1]
            rows = rows[at[rows] > 0]
        row, pos, ids = (np.concatenate([c[k] for c in chunks]) for k in range(3))
        order = np.lexsort((pos, row))
        row, pos, ids = row[order], pos[order], ids[order].astype(np.int32)
        if (ids < 0).any():
            bytes_, counts = [], np.ones(len(ids), np.int64)
            for k in np.flatnonzero(ids < 0).tolist():
                raw = group[row[k]][pos[k]].encode("utf-8", "surrogatepass")
                counts[k] = len(raw)
                bytes_.append(self.byte[np.frombuffer(raw, np.uint8)])
            unknown = np.repeat(ids < 0, counts)
            row, ids = np.repeat(row, counts), np.repeat(ids, counts)
            ids[unknown] = np.concatenate(bytes_)
        counts = np.bincount(row, minlength=len(group))
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.int32)])
        self.flat[self.used : need] = ids
        first = len(self.words)
        if first + len(group) > len(self.start):
            more = max(len(group), len(self.start))
            self.start, self.count = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.start, self.count))
        self.start[first : first + len(group)] = self.used + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.count[first : first + len(group)] = counts
        self.words.update(zip(group, range(first, first + len(group)), strict=True))
        self.used = need

    def split(self, text: str) -> list[str]:
        """Words of a text, each with the marks before it."""
        if not text:
            return []
        if self.normalise:
            return WORDS.findall(self.normalise(text))
        if self.prefix and "  " not in text and text[-1] != " " and text[0] != " " and MARK not in text:
            return text.split(" ")  # the mark is added to all of them below
        return WORDS.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and its n+1 offsets."""
        if len(self.words) > KEPT_WORDS:
            self.fresh()
        split = []
        for t in texts:
            w = self.split(t)
            if w and w[0][0] != MARK and self.prefix and not self.normalise:
                w = [MARK + x for x in w]
            split.append(w)
        new = set().union(*split).difference(self.words) if split else set()
        if new:
            self.learn(sorted(new))
        get = self.words.__getitem__
        number = np.fromiter(map(get, chain.from_iterable(split)), np.int64)
        counts = self.count[number]
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], counts)]
        return flat, ends[np.concatenate(([0], np.cumsum([len(w) for w in split], dtype=np.int64)))]

    def decode(self, ids: np.ndarray) -> str:
        get = self.bytes_of.__getitem__
        out = b"".join(map(get, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


_loaded: dict[bytes, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    if proto not in _loaded:
        _loaded[proto] = Pieces(proto)
    return _loaded[proto]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes | None = None, keep: list[str] | None = None, verify: bool = True) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, ids and, where ``verify``, round_trip: whether the ids decode to the text."""
    proto = docs.sparkSession.sparkContext.broadcast(model or read_model(docs.sparkSession.conf.get(MODEL_SETTING, MODEL)))  # the vocabulary file; its size is fixed
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    new += [T.StructField("round_trip", T.BooleanType())] * verify
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    schema = T.StructType([docs.schema[c] for c in names] + new)

    def run(batches):
        import pyarrow as pa

        p = loaded(proto.value)
        for batch in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            flat, ends = p.encode(texts)
            cols = {"n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}
            if verify:
                cols["round_trip"] = pa.array([p.decode(flat[a:b]) == t for t, a, b in zip(texts, ends, ends[1:], strict=False)], pa.bool_())
            yield add_columns(batch, cols, tuple(c for c in batch.schema.names if c not in names))

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    proto = encoded.sparkSession.sparkContext.broadcast(model or read_model(encoded.sparkSession.conf.get(MODEL_SETTING, MODEL)))
    schema = T.StructType([f for f in encoded.schema if f.name != name] + [T.StructField(name, T.StringType())])

    def run(batches):
        import pyarrow as pa

        p = loaded(proto.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            out = [None if x is None else p.decode(np.array(x, np.int64)) for x in col.to_pylist()]
            yield add_columns(batch, {name: pa.array(out, pa.string())})

    return encoded.mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.withColumn("ids_sha256", F.sha2(F.array_join("ids", ","), 256))
