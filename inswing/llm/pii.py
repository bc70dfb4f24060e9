"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the cues that stand before
identifiers. Each anchor is handed to a small local parser that grows the span to the left and right, checks it, and
drops it if the check fails. A parser never starts inside the span its kind took last, whether that was kept or dropped,
so spans of a kind never overlap and nothing is tried twice.

Kinds, in the order in which spans that start at the same place are listed:

* email, ip, card, phone: the base kinds, equal to leftmost matches of their patterns, then checked;
* account: two letters, two digits and 11 to 30 letters or digits, in groups of four if blanks stand between them, whose
  remainder by 97 is 1 (an international account number);
* secret: the value behind a cue such as `token =` or `api_key:`, eight characters or longer;
* url: a scheme with user data (`user:password@`) before the host.

Defined results. A null or empty text has no spans: counts of 0, the digest of the empty string, an empty list. Offsets
count code points, end exclusive. Whole texts are read whatever their length; a task holds one Arrow batch of texts.
Rows that repeat give rows that repeat; an empty table gives an empty result; extra columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inswing.llm.common import text_of

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE = KINDS[:4]
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
SCHEMES = ("http://", "https://", "ftp://")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SECRET = re.compile(r"""["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9_./+=-]{8,})""")
URL = re.compile(r"[A-Za-z]+://[^\s/?#@\"'<>]+:[^\s/?#@\"'<>]*@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    plain = account.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    for scheme in SCHEMES:
        a.add_word(scheme, ("scheme", len(scheme)))
    a.make_automaton()
    return a


class Finder:
    """The parsers, and for each kind the end of the last span it took."""

    def __init__(self, anchors: ahocorasick.Automaton):
        self.anchors = anchors

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order."""
        out: list[tuple[int, int, int]] = []
        done = [0] * len(KINDS)
        self.text, self.out, self.done = text, out, done
        for last, (what, n) in self.anchors.iter(text):
            at = last - n + 1
            if what == "digit":
                if at >= done[1]:
                    self.ip(at)
                if at >= done[2]:
                    self.card(at)
                if at >= done[4] and at >= 2:
                    self.account(at)
            elif what == "at":
                self.email(at)
            elif what == "plus":
                if at >= done[3]:
                    self.phone(at)
            elif what == "cue":
                self.secret(last + 1)
            elif at >= done[6]:
                self.url(at)
        out.sort()
        return out

    def email(self, at: int) -> None:
        text, left = self.text, at
        while left > self.done[0] and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (m := EMAIL.match(text, left)):
            self.done[0] = m.end()
            self.out.append((left, 0, m.end()))

    def ip(self, at: int) -> None:
        m = IP.match(self.text, at)
        if not m:
            while at < len(self.text) and self.text[at] in DIGITS:  # nothing can start inside this run
                at += 1
            self.done[1] = at
            return
        self.done[1] = m.end()
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            self.out.append((m.start(), 1, m.end()))

    def card(self, at: int) -> None:
        m = CARD.match(self.text, at)
        if not m:
            self.done[2] = at + 1
            return
        self.done[2] = m.end()
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            self.out.append((m.start(), 2, m.end()))

    def phone(self, at: int) -> None:
        m = PHONE.match(self.text, at)
        if not m:
            return
        self.done[3] = m.end()
        if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
            self.out.append((at, 3, m.end()))

    def account(self, at: int) -> None:
        text, start = self.text, at - 2
        if start < self.done[4] or start and (text[start - 1].isalnum()):
            return
        m = ACCOUNT.match(text, start)
        if m and mod_97(m[0]):
            self.done[4] = m.end()
            self.out.append((start, 4, m.end()))

    def secret(self, after: int) -> None:
        m = SECRET.match(self.text, after)
        if m and m.start(1) >= self.done[5]:
            self.done[5] = m.end(1)
            self.out.append((m.start(1), 5, m.end(1)))

    def url(self, at: int) -> None:
        m = URL.match(self.text, at)
        if m:
            self.done[6] = m.end()
            self.out.append((at, 6, m.end()))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder(automaton())
    for batch in batches:
        found = [finder.spans(t) for t in batch.column(1).to_pylist()]
        joined = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in f) for f in found]
        base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in f if k < len(BASE)) for f in found]
        counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(joined, pa.string())],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts by kind, the digest of the base spans, and all spans."""
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        _batches, f"doc_id long, {kinds}, base_sha256 string, spans string")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets; of spans that overlap, the first stays."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(automaton())
        for batch in it:
            out = []
            for t in batch.column(1).to_pylist():
                parts, at = [], 0
                for s, k, e in finder.spans(t):
                    if s >= at:
                        parts += [t[at:s], f"<{KINDS[k]}>"]
                        at = e
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(batches, "doc_id long, text string")
