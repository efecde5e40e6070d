"""Text functions as column expressions: lines, references, globs, configuration values and signatures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line terminators by name.
EOLS = {"crlf": "\r\n", "lf": "\n", "cr": "\r", "nul": "\0"}


def _pattern(accepted: tuple[str, ...]) -> str:
    """Alternation of the accepted terminators; the two-character one is tried first."""
    names = [n for n in ("crlf", "lf", "cr", "nul") if n in accepted]
    return "|".join({"crlf": r"\r\n", "lf": r"\n", "cr": r"\r", "nul": r"\x00"}[n] for n in names)


def lines(text: Column, accepted: tuple[str, ...] = ("crlf", "lf", "cr")) -> Column:
    """Array of (line, eol); a last line without terminator has an empty eol, and no empty line follows a final terminator."""
    pattern = _pattern(accepted)
    ends = F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))
    both = F.struct(ends.alias("ends"), F.split(text, pattern, -1).alias("parts"))
    # bound once: an expression within a lambda would be computed for each line
    rows = F.transform(F.array(both), lambda v: F.transform(v["parts"], lambda p, i: F.struct(p.alias("line"), F.coalesce(F.get(v["ends"], i), F.lit("")).alias("eol"))))
    return F.filter(F.get(rows, F.lit(0)), lambda r: (r["line"] != "") | (r["eol"] != ""))


def normalize_eols(text: Column, accepted: tuple[str, ...], produced: str) -> Column:
    """Rewrite the accepted terminators; others are data."""
    return F.regexp_replace(text, _pattern(accepted), produced.replace("\\", "\\\\").replace("$", "\\$"))


def indent(text: Column) -> Column:
    """Put a space after each line feed, as header continuation lines have it."""
    return F.regexp_replace(text, "\n", "\n ")


def unindent(text: Column) -> Column:
    return F.regexp_replace(text, "\n ", "\n")


def first_line(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "\n", 2), 0))


def summary(text: Column) -> Column:
    """The lines before the first blank one, four at most."""
    heads = F.slice(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", 6), 1, 4)
    blank = F.array_position(F.transform(heads, lambda x: F.trim(x) == ""), True)
    return F.array_join(F.when(blank > 0, F.slice(heads, F.lit(1), (blank - 1).cast("int"))).otherwise(heads), "\n")


def short_ref(name: Column) -> Column:
    """A reference's name without its well-known prefix; of other names under refs/ only "refs" goes."""
    out = F.when(name.startswith("refs/heads/"), F.substring(name, 12, 1 << 20))
    out = out.when(name.startswith("refs/remotes/"), F.substring(name, 14, 1 << 20)).when(name.startswith("refs/tags/"), F.substring(name, 11, 1 << 20))
    return out.when(name.startswith("refs/"), F.substring(name, 5, 1 << 20)).otherwise(name)


def valid_ref(name: Column, allow_caps: bool = False) -> Column:
    """Whether a string may name a reference."""
    fine = name.rlike(r"^[^\x00-\x20\x7f~^:?*\[\\]+$") & ~name.rlike(r"\.\.|@\{|//|/\.|/$|\.$|\.lock(/|$)|^[./]|^@$")
    if allow_caps:
        return fine & (F.contains(name, F.lit("/")) | name.rlike("^[A-Z_]+$"))
    return fine & F.contains(name, F.lit("/"))


def glob_regex(glob: str, anywhere: bool = False) -> str:
    """Regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` do not, ``[..]`` and ``\\`` as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else body
            out, i = f"{out}[{body}]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c).replace("/", "/"), i + 1
    return f"(?:^|/){out}$" if anywhere else f"^{out}$"


def glob_match(path: Column, glob: str, anywhere: bool = False) -> Column:
    return path.rlike(glob_regex(glob, anywhere))


def config_bool(value: Column, present: Column | None = None) -> Column:
    """True or false for the accepted words, true for a key without value, null for anything else."""
    v = F.lower(value)
    out = F.when(v.isin("true", "yes", "on", "1"), True).when(v.isin("false", "no", "off", "0", ""), False)
    return F.when(value.isNull() & (present if present is not None else F.lit(True)), F.lit(True)).otherwise(out)


def config_int(value: Column) -> Column:
    """A number with an optional k, m or g; null where it is none."""
    number = F.regexp_extract(value, r"^\s*([+-]?[0-9]{1,15})([kKmMgG]?)\s*$", 1)
    unit = F.lower(F.regexp_extract(value, r"^\s*([+-]?[0-9]{1,15})([kKmMgG]?)\s*$", 2))
    factor = F.when(unit == "k", F.lit(1 << 10)).when(unit == "m", F.lit(1 << 20)).when(unit == "g", F.lit(1 << 30)).otherwise(F.lit(1))
    return number.try_cast("long") * factor.cast("long")


def config_unescape(value: Column) -> Column:
    """Resolve backslash escapes: n, t, b and r are control characters, others stand for themselves."""
    parts = F.split(value, r"\\\\", -1)  # an escaped backslash must not begin another escape

    def one(p: Column) -> Column:
        for letter, char in (("n", "\n"), ("t", "\t"), ("b", "\b"), ("r", "\r")):
            p = F.regexp_replace(p, rf"\\{letter}", char)
        return F.regexp_replace(p, r"\\(.)", "$1")

    return F.array_join(F.transform(parts, one), "\\")


def expand_home(path: Column, home: str) -> Column:
    return F.when(path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(path, 3, 1 << 20))).otherwise(path)


SIGNATURE = r"^(.*?) ?<([^>]*)> ?(-?[0-9]+) ([+-][0-9]{4})$"


def parse_signature(line: Column) -> Column:
    """``Name <email> epoch ±hhmm`` as (name, email, epoch, tz_offset_min, instant); null where it is none."""
    part = lambda i: F.regexp_extract(line, SIGNATURE, i)
    zone = part(4).try_cast("int")
    epoch = part(3).try_cast("long")
    minutes = F.signum(zone) * (F.floor(F.abs(zone) / 100) * 60 + F.abs(zone) % 100)
    out = F.struct(part(1).alias("name"), part(2).alias("email"), epoch.alias("epoch"), minutes.cast("int").alias("tz_offset_min"), F.timestamp_seconds(epoch).alias("instant"))
    return F.when(line.rlike(SIGNATURE), out)


def format_zone(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%02d%02d", F.floor(size / 60).cast("int"), (size % 60).cast("int")))


def format_signature(name: Column, email: Column, epoch: Column, minutes: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit("> "), epoch.cast("string"), F.lit(" "), format_zone(minutes))


def is_id(text: Column) -> Column:
    """Whether a text is a whole object id, trailing white space aside."""
    return F.rtrim(text).rlike(r"^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")


def format_id(id_: Column, digits: int | None = None, upper: bool = False) -> Column:
    out = F.upper(id_) if upper else F.lower(id_)
    return F.substring(out, 1, digits) if digits else out


def is_zero_id(id_: Column) -> Column:
    return id_.rlike("^0+$")


def mode_of_octal(text: Column) -> Column:
    return F.conv(text, 8, 10).cast("long")
