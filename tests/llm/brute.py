"""Plain statements of what the queries must return, for small tables."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def quality(text):
    w = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i:i + 3])].append(i)
    covered = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def phrases(text):
    w = LICENSE_WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(d) for d in reversed(digits))) % 10 == 0


def personal(text):
    spans, n = [], Counter()
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
            n[kind] += 1
    names = list(KINDS)
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(n[k] for k in names), hashlib.sha256(joined.encode()).hexdigest())


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def similar(docs, threshold=0.8):
    """{doc_id: (class_id, n_links)} of documents with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    root, links = {d: d for d in sets}, Counter()
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {d: (root[d], links[d]) for d in sets}
