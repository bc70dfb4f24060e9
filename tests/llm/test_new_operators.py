"""op11 and op13 against brute force, ids of op2 against the tokenizer, op9 against a search of runs."""
from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from inswing.llm import divergence, lines, middle, similarity, tokenfiles
from tests.llm.conftest import ODD


def audit(rows, low=3, top=200):
    """All terms of all groups, one by one."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))) for _, text, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, k in df[lang].items() if k >= low]
        names = sorted(s for x, s in counts if x == lang)
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (sum(counts[lang, s][u] for u in kept) + len(kept)) for t in kept} for s in names}
        every = {t: sum(counts[lang, s][t] for s in names) for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + len(kept)) for t in kept}
        for s in names:
            pair = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in names if o != s]
            term = [((share[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_equals_all_terms_of_all_groups(frame, odd, clashing):
    rng = random.Random(4)
    words = "Alpha beta GAMMA delta é ünder x1y".split()
    rows = [(i, " ".join(rng.choices(words, weights=[9, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(120)]
    rows += [(900, "alone", "zz", "p"), (901, None, "zz", "q"), (902, "", "zz", None)]  # a language without kept terms
    assert sorted(map(tuple, divergence.audit(frame(rows)).collect())) == audit(rows)
    assert sorted(map(tuple, divergence.audit(odd).collect())) == audit([(r + (None,) * 4)[:4] for r in ODD])
    assert sorted(map(tuple, divergence.audit(clashing).collect())) == sorted(map(tuple, divergence.audit(odd).collect()))
    assert divergence.audit(odd.limit(0)).count() == 0


def test_divergence_with_one_hot_source(frame):
    """Most rows of one source, many equal; top cuts ties by the item."""
    rows = [(i, f"w{chr(97 + i % 26)} common " * (1 + i % 3), "en", "hot") for i in range(300)] + [(i, f"common w{chr(97 + i % 5)}", "en", f"s{i % 7}") for i in range(60)]
    assert sorted(map(tuple, divergence.audit(frame(rows), top=4).collect())) == audit(rows, top=4)


def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_plain_cutting_and_comes_back(frame, odd, clashing):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, "".join(rng.choice(["line\n", "\n", "é\n", "<", "<P", "P>", "<M>" if rng.random() < .05 else "x", "S>", "\r\n"]) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(r[0], r[1]) for r in ODD]
    done = middle.transform(frame(rows))
    back = done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in back), key=str) == sorted((cut(*r) for r in rows), key=str)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert sorted(map(tuple, middle.report(clashing).collect()), key=str) == sorted(map(tuple, middle.report(odd).collect()), key=str)
    assert middle.report(odd.limit(0)).count() == 0


def test_ids_of_every_letter_before_a_mark():
    """Some letters become a letter and a mark in the tokenizer; what follows then joins them."""
    e = tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and not 0x3400 < c < 0xD7A4 and c < 0x10000]
    texts = [f"{c}{m} a{c}{m}" for c in letters for m in ".!"] + ["TÜRKİ, x İ.", "क़. फ़िल्म़, हिन्दी।", "שָׁלוֹם. שּׁ, x"]
    assert e.encode(texts) == [x.tobytes() for x in e.plain(texts)]


def test_encoder_forgets_the_older_half(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KNOWN_WORDS", 50)
    e = tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(30):
        texts = [f"w{chr(97 + j % 26)}{chr(97 + (i * 7 + j) % 26)}x, again and again." for j in range(40)]
        assert e.encode(texts) == [x.tobytes() for x in e.plain(texts)]
    assert len(e.words) < 250 and len(e.pieces) < 250


def test_words_before_runs_of_marks_are_encoded_together(monkeypatch):
    """Ids are those of the whole text, also where a special token, a digit or an apostrophe stands before a mark."""
    e = tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    odd = ["", " ", "\n\n", "x, ", "***", "a,\u0301 b", "don't. it's, s's!", "<|endoftext|>. a<|startoftext|>, <|ENDOFTEXT|>!", "a1. 2b, 33:", "É, é.\u0327 x\u0301, ẞ;", "a\t, b.\r\n c;\n"]
    odd += ["".join(rng.choice(list("aZé1 \n\t'.,;:!?*#$%&|<>_\u0301") + ["word", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert e.encode(odd) == [x.tobytes() for x in e.plain(odd)]
    assert e.encode(pa.array(["cut away", *odd])[1:]) == e.encode(odd) and e.encode([]) == []
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}{m}" for i in range(200) for m in ("***", "$$", "%,")]
    want, alone, plain = [x.tobytes() for x in e.plain(texts)], [], e.plain
    monkeypatch.setattr(e, "plain", lambda t: alone.extend(t) or plain(t))
    assert e.encode(texts) == want and len(alone) < 20


def test_signing_holds_the_ngrams_of_a_few_documents_at_once():
    n, words = 4096, 300
    rng = np.random.default_rng(4)
    w = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(rng.integers(-2**63, 2**63, n * words, dtype=np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), w], names=["doc_id", "w"])
    for run in (similarity._signer(18, 4, 5), similarity._keyed(5)):
        alone = pa.Table.from_batches(run(iter([batch.slice(4000, 7)])))
        tracemalloc.start()
        got, at = [], 0
        for b in run(iter([batch])):
            if at < 4007 and at + b.num_rows > 4000:
                got.append(b.slice(max(0, 4000 - at), 4007 - max(at, 4000)))
            at += b.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert at == n and pa.Table.from_batches(got).equals(alone) and peak < w.nbytes


def runs(rows, words=20, span=30):
    """Every run of units of every text."""
    cut = {}
    for doc, text in rows:
        units, unit = [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            unit.append((m.start(), m.end(), m.group().lower()))
            if unit[-1][2][-1] in ".!?,;:r":
                units.append(unit)
                unit = []
        cut[doc] = units + ([unit] if unit else [])
    first, spans = {}, []
    for doc in sorted(cut):
        units, own, hit = cut[doc], {}, set()
        for a in range(len(units)):
            b = a
            while b < len(units) and sum(map(len, units[a:b])) < words:
                b += 1
            if sum(map(len, units[a:b])) < words:
                break
            key = tuple(" ".join(w for _, _, w in u) for u in units[a:b])
            if own.setdefault(key, b - 1) < a or first.setdefault(key, doc) != doc:
                hit |= {(s, e) for u in units[a:b] for s, e, _ in u}
        order = [(s, e) for u in units for s, e, _ in u]
        at = None
        for i, w in enumerate(order + [None]):
            if w in hit:
                at = i if at is None else at
            elif at is not None:
                if i - at >= span:
                    spans.append((doc, order[at][0], order[i - 1][1], i - at))
                at = None
    return spans


def test_passages_inside_lines(frame, odd, clashing):
    rng = random.Random(8)
    vocabulary = "one two three, four. fiver sixsix seven; eight nine tenten eleven! twelve".split()
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 90))) for _ in range(5)]
    rows = [(i, " ".join(rng.choices(vocabulary + ["x1", "y22", "z333"], k=rng.randint(5, 40))) + rng.choice([" ", "\n"]) + rng.choice(passages) + " " + str(i)) for i in range(40)]
    got = sorted((r.doc_id, r.start, r.end, r.n_words) for r in lines.clauses(frame(rows)).collect())
    assert got == sorted(runs(rows)) and len(got) > 25
    kept = lines.clean(clashing, find=lines.clauses)
    assert kept.columns == clashing.columns and kept.count() == len(ODD) and lines.clauses(odd.limit(0)).count() == 0
