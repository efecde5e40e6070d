"""HTML extraction by equivalence-class template deduction.

Pages of one host are dealt into groups of bounded size.  Within a group every
token (a tag told apart by its class and id, or a stretch of text) has an
occurrence vector: how often each page has it.  Tokens that occur once in every
page, in one order, are the root class of the template.  In each of its slots,
the stretches between two of its tokens, the tokens that share another vector
form a repeated class: the slot's stretches are cut where its first token
occurs, and the pieces have a root class of their own, and so on.

The slots decide what is read.  The group's pages vote on each slot by whether
its text lies within their article element; a slot that nearly all pages place
inside is read on every page, also on one without the element or with a broken
one, and a slot that nearly all place outside is read on none.  Where the votes
differ the page's own elements decide.  In groups without the element a slot is
read unless most of its text is links.  Texts that are tokens of a class repeat
from page to page and are left out everywhere.  Groups of less than MIN_PAGES
different articles have no template; there the article element or the whole
body is read.

Defined results: a null page is empty and gives an empty text; null urls form
one host; pages cut short are read to their end; equal pages in one group give
equal texts; rows that repeat page_id, url and html are read once and returned
as often; columns other than page_id, url and html are not read, so their names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

#: Pages of a group; a host with more is dealt into several groups.
GROUP_PAGES = 48
MIN_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp".split())
SKIP = frozenset(
    "nav footer aside form script style noscript iframe button select textarea template svg math menu dialog object canvas audio video head title".split()
)
#: Share of a group's pages that decides for the others where a slot lies.
NEARLY_ALL = 0.9
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

OPEN, CLOSE, TEXT = 0, 1, 2


def tokens(html: str) -> list[tuple[int, str, str]]:
    """(kind, tag or text, attributes) in page order; comments, declarations and raw contents are left out."""
    out, at, n = [], 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        name = m.group(2)
        if name:
            name = name.lower()
            out.append((CLOSE if m.group(1) else OPEN, name, m.group(3)))
            if name in RAW and not m.group(1):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = end.start() if end else n
        elif not m.group().startswith(("<!", "<?")):
            if out and out[-1][0] == TEXT:
                out[-1] = (TEXT, out[-1][1] + m.group(), "")
            else:
                out.append((TEXT, m.group(), ""))
    return out


def attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)} if raw else {}


def outside(name: str, raw: str, inside: bool) -> bool:
    """Whether an element is never part of an article; ``inside``: whether it stands within one."""
    if name in SKIP or name == "header" and not inside:
        return True
    if not raw or name in ("html", "body", "article", "main"):
        return False
    attrs = attributes(raw)
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def keyed(toks: list[tuple[int, str, str]]) -> list[str]:
    """A key for each token: a tag is told apart by its attributes' words, a text by its words."""
    out = []
    for kind, name, raw in toks:
        if kind == TEXT:
            out.append("t:" + " ".join(name.split()))
        elif kind == CLOSE:
            out.append("/" + name)
        else:
            a = attributes(raw) if name not in ("a", "link", "meta", "img") else {}
            out.append(f"<{name} {a.get('class', '')}#{a.get('id', '')}")
    return out


def classes(keys: list[list[str]]) -> dict[tuple[int, ...], list[str]]:
    """Occurrence vector -> tokens that have it, for tokens found in every page; blank texts are no tokens."""
    counts = [Counter(k) for k in keys]
    common = set(counts[0]).intersection(*counts[1:]) - {"t:"}
    out: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for k in sorted(common):
        out[tuple(c[k] for c in counts)].append(k)
    return dict(out)


Span = tuple[int, int, int]  #: page, first token, end


class Template:
    """The nested classes of a group of pages: for each token its slot, and whether it is one of a class."""

    def __init__(self, keys: list[list[str]]):
        self.keys = keys
        self.slot = [[0] * len(page) for page in keys]
        self.member = [bytearray(len(page)) for page in keys]
        self.slots = 1
        work = [[(p, 0, len(page)) for p, page in enumerate(keys) if page]]
        while work:
            for stretches in self._slots_of(work.pop()):
                pieces = self._repeated(stretches)
                if pieces:
                    work.append(pieces)

    def _slots_of(self, spans: list[Span]) -> list[list[Span]]:
        """Mark the class of the tokens that every span has once, in one order, and number the slots between them."""
        order = self._once(spans)
        out: list[list[Span]] = [[] for _ in range(len(order) + 1)]
        for p, a, b in spans:
            index = {k: i for i, k in enumerate(order)}
            at, last = a, 0
            for i in range(a, b):
                k = index.get(self.keys[p][i])
                if k is not None:
                    self.member[p][i] = 1
                    out[last].append((p, at, i))
                    at, last = i + 1, k + 1
            out[last].append((p, at, b))
        for n, stretches in enumerate(out, self.slots):
            for p, a, b in stretches:
                self.slot[p][a:b] = [n] * (b - a)
        self.slots += len(out)
        return [[x for x in stretches if x[1] < x[2]] for stretches in out]

    def _once(self, spans: list[Span]) -> list[str]:
        places = []
        for p, a, b in spans:
            seen: dict[str, int] = {}
            for i, k in enumerate(self.keys[p][a:b]):
                seen[k] = -1 if k in seen else i
            places.append({k: i for k, i in seen.items() if i >= 0 and k != "t:"})
        common = set(places[0]).intersection(*places[1:])
        kept: list[str] = []
        for k in sorted(common, key=places[0].get):
            if not kept or all(at[kept[-1]] < at[k] for at in places):
                kept.append(k)
        return kept

    def _repeated(self, stretches: list[Span]) -> list[Span]:
        """The slot's stretches cut at the first token of its outermost repeated class (the rarest); none if there is no such class."""
        if len(stretches) < MIN_PAGES:
            return []
        vectors = classes([self.keys[p][a:b] for p, a, b in stretches])
        several = [(v, members) for v, members in vectors.items() if max(v) > 1 and len(members) > 1]
        if not several:
            return []
        _, members = min(several, key=lambda x: (sum(x[0]), -len(x[1]), x[1]))
        p, a, b = stretches[0]
        inside = set(members)
        head = next(k for k in self.keys[p][a:b] if k in inside)
        out = []
        for p, a, b in stretches:
            at = [i for i in range(a, b) if self.keys[p][i] == head]
            out += [(p, x, y) for x, y in zip(at, [*at[1:], b], strict=True)]
        return out


def article(toks: list[tuple[int, str, str]], keys: list[str]) -> tuple[str, ...]:
    """The texts within the article element or, on a page without one, all keys."""
    main, inside = 0, []
    for (kind, name, _), k in zip(toks, keys, strict=True):
        if kind == TEXT:
            if main and k != "t:":
                inside.append(k)
        elif name in MAIN:
            main = max(0, main + (1 if kind == OPEN else -1))
    return tuple(inside) if has_article(toks) else tuple(keys)


def has_article(toks: list[tuple[int, str, str]]) -> bool:
    return any(kind == OPEN and name in MAIN for kind, name, _ in toks)


def places(toks: list[tuple[int, str, str]]) -> tuple[bytearray, bytearray, bytearray]:
    """For each token whether it lies within the article element, within a link, and within an element that is never read."""
    n = len(toks)
    inside, linked, skipped = bytearray(n), bytearray(n), bytearray(n)
    main = link = skip = 0
    stopped = ""
    for i, (kind, name, raw) in enumerate(toks):
        if skip:
            skipped[i] = 1
            if kind != TEXT and name == stopped:
                skip += 1 if kind == OPEN else -1
            continue
        if kind == OPEN and outside(name, raw, main > 0):
            skipped[i] = 1
            if name not in VOID and not raw.endswith("/"):
                skip, stopped = 1, name
            continue
        if kind != TEXT and name in MAIN:
            main = max(0, main + (1 if kind == OPEN else -1))
        elif kind != TEXT and name == "a":
            link = max(0, link + (1 if kind == OPEN else -1))
        inside[i], linked[i] = main > 0, link > 0
    return inside, linked, skipped


class Plan:
    """What the slots of a group's template decide."""

    def __init__(self, pages: list[list[tuple[int, str, str]]], keys: list[list[str]], where: list[tuple[bytearray, bytearray, bytearray]]):
        self.template = t = Template(keys)
        votes: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])  # pages that have a slot's text outside, inside, on both sides
        text, links = Counter(), Counter()
        for p, toks in enumerate(pages):
            sides: dict[int, set[int]] = defaultdict(set)
            own = has_article(toks)
            inside, linked, skipped = where[p]
            for i, (kind, name, _) in enumerate(toks):
                size = len(name.strip()) if kind == TEXT and not t.member[p][i] else 0
                if size:
                    if own:
                        sides[t.slot[p][i]].add(0 if skipped[i] else inside[i])
                    elif not skipped[i]:
                        text[t.slot[p][i]] += size
                        links[t.slot[p][i]] += size * linked[i]
            for slot, side in sides.items():
                votes[slot][2 if len(side) > 1 else min(side)] += 1
        self.read = {}
        for slot, v in votes.items():
            for side in (0, 1):
                if v[side] >= NEARLY_ALL * sum(v):
                    self.read[slot] = bool(side)
        self.plain = {s for s in text if links[s] <= 0.5 * text[s]}

    def keeps(self, p: int, i: int, own: bool, inside: bool) -> bool:
        """Whether the text i of page p is the article's; ``own``: whether the page has an article element."""
        if self.template.member[p][i]:
            return False
        slot = self.template.slot[p][i]
        return self.read.get(slot, inside if own else slot in self.plain or not self.plain)


def planned(pages, keys, where) -> Plan | None:
    """The plan of a group; None: too few different articles for a template.  Pages of one article are copies and count once, empty pages not at all."""
    once = {article(toks, page) for toks, page in zip(pages, keys, strict=True) if page}
    return Plan(pages, keys, where) if len(once) >= MIN_PAGES else None


def read(p: int, toks: list[tuple[int, str, str]], where: tuple[bytearray, bytearray, bytearray], plan: Plan | None) -> str:
    """The blocks of a page's article."""
    own = has_article(toks)
    inside, _, skipped = where
    blocks: list[list[str]] = [[]]
    for i, (kind, name, _) in enumerate(toks):
        if skipped[i]:
            if blocks[-1] and name in BLOCKS and kind != TEXT:
                blocks.append([])
        elif kind == TEXT:
            if plan.keeps(p, i, own, bool(inside[i])) if plan else inside[i] or not own:
                blocks[-1].append(name)
        elif name in BLOCKS:
            blocks.append([])
        elif name == "br":
            blocks[-1].append(" ")
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def extract(htmls: list[str]) -> list[str]:
    """Main text of each page of one group of pages of a host."""
    pages = [tokens(h) for h in htmls]
    keys = [keyed(p) for p in pages]
    where = [places(p) for p in pages]
    plan = planned(pages, keys, where)
    return [read(p, toks, w, plan) for p, (toks, w) in enumerate(zip(pages, where, strict=True))]


def grouped(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """``pages`` with host and salt: groups of about ``group_pages`` pages, whatever a host's share of the rows."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    counts = pages.select(host.alias("host")).groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group_pages).cast("long").alias("salts"))
    counts = materialize(counts, "html-hosts")
    # a written table of one row a host: broadcast while it is under Spark's threshold
    dealt = pages.withColumn("host", host).join(counts, "host", "left")
    return dealt.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.greatest("salts", F.lit(1)))).drop("salts")


def repeated_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) with ``copies``: rows that repeat all three are one, so that they cannot crowd one group."""
    key = F.xxhash64("html")
    again = pages.groupBy("page_id", "url", key.alias("key")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = materialize(again.select(F.col("page_id").alias("a_id"), F.col("url").alias("a_url"), "key"), "html-again", thin=True)
    if again.isEmpty():
        return pages.withColumn("copies", F.lit(1).cast("long"))
    on = pages["page_id"].eqNullSafe(again["a_id"]) & pages["url"].eqNullSafe(again["a_url"]) & (key == again["key"])
    several = pages.join(again, on, "left_semi").groupBy("page_id", "url", "html").agg(F.count(F.lit(1)).alias("copies"))
    return pages.join(again, on, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(several)


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("copies", T.LongType())])

    def run(group):
        import pyarrow as pa

        texts = extract([h or "" for h in group.column("html").to_pylist()])
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "copies": group.column("copies")})

    found = grouped(repeated_rows(pages.select("page_id", "url", "html")), group_pages).groupBy("host", "salt").applyInArrow(run, schema)
    each = F.when(F.col("copies") > 1, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array(F.lit(1)))
    return found.withColumn("copy", F.explode(each)).drop("copy", "copies")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
