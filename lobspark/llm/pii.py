"""Operator 7: personal data, also where it is disguised, at its place in the source text.

Plain identifiers are found first. Then a chain of transducers rewrites the text: look-alike characters and invisible
ones, spelled digits, and disguised at and dot signs. Each rewritten character keeps the source range it was made from,
the identifiers found in the rewritten text are mapped back through these ranges, and those that are new are added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.llm.common import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # within a run of digits none begins where its first digit didn't
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part, as far as the match before; linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaoepvikTuABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("․。‧∙", ".") | {" ": " "}
INVISIBLE = frozenset("­​‌‍⁠﻿")

#: Spelled digits of four languages (fixed values).
DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
_SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
_RUN = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_SPELLED}|[0-9])(?:[\s,-]+(?:dot[\s-]+)?(?:{_SPELLED}|[0-9]+))++\b", re.I)
_TOKEN = re.compile(rf"\b(?:plus|dot|{_SPELLED})\b|[0-9]+", re.I)
_SIGN = re.compile(r"(?<=[\w%+-])\s*[\[({<]\s*(at|arroba|dot|punkt|point|punto|@|\.)\s*[\])}>]\s*(?=\w)", re.I)
_BARE = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+(\s+(?:at|arroba)\s+|\s*@\s*)[A-Za-z0-9-]+((?:(?:\s+(?:dot|punkt|point|punto)\s+|\s*\.\s*|\.)[A-Za-z0-9-]+)+)", re.I)
_BARE_DOT = re.compile(r"\s+(?:dot|punkt|point|punto)\s+|\s+\.\s*|\.\s+", re.I)
_IP_DOT = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\s+(?:dot|punkt|point|punto)\s+|\s*\.\s*)[0-9]{1,3}){3}(?![\w])", re.I)
#: What every match of a step's pattern holds, as a part of that pattern; a step is left out only where its own is missing.
_HAS_SIGN = re.compile(r"[\[({<]\s*(?:at|arroba|dot|punkt|point|punto|@|\.)\s*[\])}>]", re.I)
_HAS_BARE = re.compile(r"@|\s(?:at|arroba)\s", re.I)
_HAS_IP_DOT = re.compile(r"[0-9](?:\s+(?:dot|punkt|point|punto)\s+|\s*\.\s*)[0-9]", re.I)
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


class Rewritten:
    """A text with the source range of each of its characters."""

    def __init__(self, source: str):
        self.text = source
        self.starts: list[int] = []  # made at the first change
        self.ends: list[int] = []

    def edit(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces ranges (in order, apart from each other); the new characters come from the whole range."""
        if not changes:
            return
        if not self.starts:
            self.starts = list(range(len(self.text)))
            self.ends = list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            text.append(new)
            if b > a:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        self.text = "".join(text)


_plain_of: dict[str, str] = {}


def plain(c: str) -> str:
    """The ASCII character that ``c`` stands for, nothing for an invisible one, or ``c``."""
    if c not in _plain_of:
        new = LOOKALIKES.get(c, c)
        if c in INVISIBLE:
            new = ""
        elif new == c:
            n = unicodedata.normalize("NFKC", c)
            d = unicodedata.decimal(c, None)
            new = str(d) if d is not None else n if len(n) == 1 and n.isascii() else c
        _plain_of[c] = new
    return _plain_of[c]


def characters(r: Rewritten) -> None:
    r.edit([(m.start(), m.end(), new) for m in _NOT_ASCII.finditer(r.text) if (new := plain(m[0])) != m[0]])


def spelled_digits(r: Rewritten) -> None:
    changes = []
    for m in _RUN.finditer(r.text):
        parts = [t[0].lower() for t in _TOKEN.finditer(m[0])]
        if sum(p in DIGITS for p in parts) >= 4:
            changes.append((*m.span(), "".join("+" if p == "plus" else "." if p == "dot" else DIGITS.get(p, p) for p in parts)))
    r.edit(changes)


def signs(r: Rewritten) -> None:
    """[at], (dot) and the like between words; then bare "at" and "dot" where an address's whole shape stands."""
    if _HAS_SIGN.search(r.text):
        r.edit([(*m.span(), "@" if m[1].lower() in ("at", "arroba", "@") else ".") for m in _SIGN.finditer(r.text)])
    changes = []
    for m in _BARE.finditer(r.text) if _HAS_BARE.search(r.text) else ():
        disguised = not m[1].strip().startswith("@") or m[1] != "@" or _BARE_DOT.search(m[2])
        spelled = re.search(r"\s(?:dot|punkt|point|punto)\s", m[2], re.I)
        if not disguised or (m[1].strip() != "@" and not spelled) or (m[1].strip() == "@" and not spelled and re.search(r"\.\s", m[2])):
            continue
        changes.append((*m.span(1), "@"))
        changes += [(m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in _BARE_DOT.finditer(m[2])]
    r.edit(changes)
    changes = []
    for m in _IP_DOT.finditer(r.text) if _HAS_IP_DOT.search(r.text) else ():
        changes += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _BARE_DOT.finditer(m[0])]
    r.edit(changes)


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of all personal data in code points, by kind as listed, then start.

    Plain ones are leftmost and non-overlapping within their kind. A disguised one is added unless it
    lies within a plain one of its kind. A null is an empty text.
    """
    text = text or ""
    base = {k: f(text) for k, f in FINDERS.items()}
    out = {k: [(a, b, True) for a, b in v] for k, v in base.items()}
    r = Rewritten(text)
    for step in (characters, spelled_digits, signs):
        step(r)
    if r.text != text:
        for k, f in FINDERS.items():
            new = [(r.starts[a], r.ends[b - 1], False) for a, b in f(r.text)]
            old, i = base[k], 0
            for a, b, p in new:
                while i < len(old) and old[i][1] < b:
                    i += 1
                if i == len(old) or old[i][0] > a:  # not within a plain one
                    out[k].append((a, b, p))
    return [(k, *s) for k in KINDS for s in sorted(out[k])]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def _mapped(docs: DataFrame, columns, fields: list[T.StructField]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield columns(batch)

    return docs.mapInArrow(run, T.StructType(fields))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): a row for each row of ``docs``, with all spans of its whole text."""

    def columns(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(t.as_py())] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ("doc_id", "spans"))

    return _mapped(docs.select(F.col("doc_id").cast("long"), "text"), columns, [T.StructField("doc_id", T.LongType()), T.StructField("spans", _SPAN)])


def masked_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go together, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay."""
    place = docs.columns.index("text")

    def columns(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([masked_text(t.as_py()) for t in batch.column(place)], pa.string())
        return pa.RecordBatch.from_arrays([text if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return _mapped(docs, columns, docs.schema.fields)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["plain"])
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    more = F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_disguised")
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), more)


