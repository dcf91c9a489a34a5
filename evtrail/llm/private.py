"""Operator 4: personal data, also where it is disguised, by transducers that keep offsets.

Base patterns run on the text as it stands. Then transducers rewrite it: lookalike characters to plain ones (and
invisible ones to nothing), written-out digits to digits, and disguised "at" and "dot" to @ and the full stop. Each
keeps, for every character that it writes, the part of the source that it stands for, so that what the same patterns
find in the rewritten text is mapped back to source offsets. Base spans always stay; a rewritten span is added where
it overlaps no span of its kind.

Null and empty texts hold nothing. Offsets are code points, ends exclusive. Texts may be long: each pattern is linear
in the text. Repeated rows get equal answers; a null doc_id is returned as null. An empty table gives no rows. The
report reads no other columns, whatever their names; redact() passes them on.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Runs of digits, each with the three parts that make it an address, if they follow.
DIGITS = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌαορτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwABEKMHOPCTYXIJSGaoptuvikABEZHIKMNOPTYX",
        strict=True,
    )
) | {"․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " "}
#: Characters without width.
INVISIBLE = frozenset("­​‌‍⁠﻿")
#: Digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(DIGIT_WORDS)
SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ ,-]{{1,3}})?(?:{_WORD})(?:[ ,.-]{{1,3}}(?:(?:{_WORD})(?![A-Za-z])|dot(?![A-Za-z])|[0-9]))*", re.I)
SPELLED_PART = re.compile(rf"(plus)|({_WORD})|(dot)|([0-9])", re.I)
AT = r"(?:[ ]?[\[({<][ ]?(?:at|@|a\.t)[ ]?[\])}>][ ]?|[ ]+(?:at|@)[ ]+|[ ]+@|@[ ]+)"
DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|\.|d\.o\.t|punkt|point|punto)[ ]?[\])}>][ ]?|[ ]+dot[ ]+)"
#: Last labels of addresses whose disguise is bare words only, as in "at the dot on the map".
LAST_LABELS = frozenset("com org net edu gov mil info biz io co ai app dev me tv us uk eu de fr es it nl be ch at pl se no dk fi ie pt br mx ca au nz jp cn in ru example test invalid local".split())
DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:{DOT}|\.)[A-Za-z0-9_%+-]{{1,64}}){{0,8}}?({AT}|@)[A-Za-z0-9-]{{1,63}}(?:(?:{DOT}|\.)[A-Za-z0-9-]{{1,63}})+", re.I)
DISGUISED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
INNER = re.compile(rf"({AT})|({DOT})", re.I)
#: What a disguise can't do without.
HINT_AT, HINT_DOT = re.compile(r"(?:^|[ \[({<])(?:at|@|a\.t)[ \])}>]|@ | @", re.I), re.compile(r"[ \[({<](?:dot|\.|d\.o\.t|punkt|point|punto)[ \])}>]", re.I)


def _plain(c: str) -> str | None:
    """What a character is rewritten to, None if it stands."""
    if c < " ":
        return None
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c) if "\U0001d400" <= c <= "\U0001d7ff" or "①" <= c <= "⓿" else c
    return wide if wide != c and wide.isascii() else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """At each @, from the left: the local part reaches back as far as it can, at most to the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def find(text: str) -> dict[str, list[Span]]:
    """The base patterns' spans by kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    for m in DIGITS.finditer(text):
        if m.end(1) >= 0 and all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


class Rewritten:
    """A text with, for each character, the part of the source that it stands for; at and to are None while all stand for themselves."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at: list[int] | None = None
        self.to: list[int] | None = None

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replaces parts; the characters of a replacement share the part's source."""
        if not edits:
            return self
        at = self.at if self.at is not None else list(range(len(self.text)))
        to = self.to if self.to is not None else list(range(1, len(self.text) + 1))
        text, new_at, new_to, end = [], [], [], 0
        for a, b, put in edits:
            text += (self.text[end:a], put)
            new_at += at[end:a]
            new_to += to[end:a]
            new_at += [at[a]] * len(put)
            new_to += [to[b - 1]] * len(put)
            end = b
        out = Rewritten("".join((*text, self.text[end:])))
        out.at, out.to = new_at + at[end:], new_to + to[end:]
        return out

    def source(self, span: Span) -> Span:
        if self.at is None or self.to is None:
            return span
        return self.at[span[0]], self.to[span[1] - 1]


def plain_letters(now: Rewritten) -> Rewritten:
    """Lookalikes beside plain characters of identifiers; words wholly of another script stay."""
    if now.text.isascii():
        return now
    known = {c: p for c in set(now.text) if (p := _plain(c)) is not None}
    if not known:
        return now
    return now.edit([(i, i + 1, known[c]) for i, c in enumerate(now.text) if c in known])


def plain_digits(now: Rewritten) -> Rewritten:
    """Runs of seven or more written-out digits."""
    edits = []
    for m in SPELLED.finditer(now.text):
        own = list(SPELLED_PART.finditer(m.group()))
        if sum(1 for p in own if p.group(2) or p.group(4)) < 7 and sum(1 for p in own if p.group(3)) != 3:
            continue
        put = "".join("+" if p.group(1) else DIGIT_WORDS[p.group(2).lower()] if p.group(2) else "." if p.group(3) else p.group(4) for p in own)
        edits.append((m.start(), m.end(), put))
    return now.edit(edits)


def plain_marks(now: Rewritten) -> Rewritten:
    """Disguised @ and full stops of what looks like an address."""
    dot = HINT_DOT.search(now.text)
    if not dot and not HINT_AT.search(now.text):
        return now
    edits = []
    for pattern in (DISGUISED, DISGUISED_IP) if dot else (DISGUISED,):
        for m in pattern.finditer(now.text):
            if pattern is DISGUISED and not re.search(r"[\[({<@]", m.group()) and m.group().split()[-1].rpartition(".")[2].lower() not in LAST_LABELS:
                continue
            edits += [(m.start() + i.start(), m.start() + i.end(), "@" if i.group(1) else ".") for i in INNER.finditer(m.group())]
    edits.sort()
    apart = [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]]
    return now.edit(apart)


def detect(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind."""
    base = find(text)
    now = plain_marks(plain_digits(plain_letters(Rewritten(text))))
    if now.at is None:
        return base, base
    every = {}
    for kind, spans in find(now.text).items():
        own = list(base[kind])
        for span in map(now.source, spans):
            if all(span[1] <= a or b <= span[0] for a, b in own):
                own.append(span)
        every[kind] = sorted(own)
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; the counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, digest, spans = [], [], []
            for text in b.column("text").to_pylist():
                base, every = detect(text or "")
                counts.append([len(base[k]) for k in KINDS])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    spans = sorted((a, b, k) for k, own in detect(text)[1].items() for a, b in own)
    if not spans:
        return text
    out, end, at = [], 0, 0
    while at < len(spans):
        a, b, kind = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < b:
            b = max(b, spans[at][1])
            at += 1
        out += (text[end:a], f"[{kind.upper()}]")
        end = b
    return "".join((*out, text[end:]))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars, if there, follows where the text has changed."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            out = [t if t is None else masked(t) for t in texts]
            columns = {n: b.column(n) for n in names} | {"text": pa.array(out, b.column("text").type)}
            if "n_chars" in columns:
                was = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if t == o or n is None else len(o) for n, t, o in zip(was, texts, out, strict=True)], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
