"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile("[\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return [w for w in BLANK.split(text or "") if w]


def substring_dedup(docs, k=20):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            window = tuple(w[i : i + k])
            if window in seen:
                gone[i : i + k] = [True] * k
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id] = (len(w), sum(gone), kept)
    return out


def suffix_dedup(docs, length=400):
    texts = {i: (t or "").encode() for i, t in docs}
    counts = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for doc_id, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def exact_dedup(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[BLANK.sub(" ", text or "")].append(doc_id)
    return {
        i: (min(ids), len(ids), i == min(ids), sha(text.encode())) for text, ids in groups.items() for i in ids
    }


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    """Smallest reachable value of each, over pairs that `linked` accepts."""
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def simhash(docs):
    fps = {i: fingerprint(t) for i, t in docs}
    root = roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    return {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def base_counts(text: str | None):
    t = text or ""
    w = words(t)
    lines = [line for line in t.split("\n") if words(line)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    signs = sum(t.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), signs, len(lines) - len(set(lines)), len(covered), failed


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def collocations(docs, least, longest=5, top=2000):
    """Over (lang, text) rows."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: c for g, c in counts.items() if c >= least and len(g) > 2}
    out = defaultdict(list)
    for (lang, *g), a in found.items():
        around = [c for (other, *h), c in found.items() if other == lang and len(h) > len(g)
                  and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * c >= 100 * a for c in around):
            continue
        cuts = [(counts[(lang, *g[:k])], counts[(lang, *g[k:])]) for k in range(1, len(g))]
        score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return {
        (lang, rank): (phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    }


def aligned(docs, tokenizers):
    """Rows of the tokenizer alignment, every text encoded as a whole."""
    counts, parts = Counter(), []
    for doc_id, text in docs:
        text = text or ""
        a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokenizers.b.encode(text) if text else []
        spans = []
        for ids, spelled in ((a, tokenizers.a_bytes), (b, tokenizers.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at := at + len(spelled[i])))
            spans.append((b"".join(spelled[i] for i in ids), own))
        if not text or any(x[0] != (" " + text).encode() for x in spans):
            a, b, spans = [], [], [(b"", []), (b"", [])]
        (_, sa), (_, sb) = spans
        links = [(x, y) for x, s in zip(a, sa, strict=True) for y, t in zip(b, sb, strict=True)
                 if max(s[0], t[0]) < min(s[1], t[1])]
        counts.update(links)
        ends = {e for _, e in sa} & {e for _, e in sb}
        groups, low = [], 0
        for end in sorted(ends):
            left = ",".join(str(x) for x, s in zip(a, sa, strict=True) if low < s[1] <= end)
            right = ",".join(str(x) for x, s in zip(b, sb, strict=True) if low < s[1] <= end)
            groups.append(f"{left}|{right}")
            low = end
        parts.append((doc_id, len(a), len(b), groups, links))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return {
        doc_id: (n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
                 sum(counts[x] for x in links), sha(";".join(groups).encode()) if groups else "")
        for doc_id, n_a, n_b, groups, links in parts
    }


def license_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def base_licenses(text: str | None, phrases):
    """(n_words, n_base, first, last, labels) of the phrases that always count."""
    w = license_words(text)
    hits = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + phrase.count(" ") + 1] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def maximal_matches(words, sequences, least):
    """(end, length) of the longest run ending at each word that stands in a sequence, where the next word does not prolong it."""
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    size, sizes = 0, []
    for i in range(len(words)):
        size += 1
        while size and tuple(words[i - size + 1 : i + 1]) not in runs:
            size -= 1
        sizes.append(size)
    return [(i, n) for i, n in enumerate(sizes) if n >= least and (i + 1 == len(sizes) or sizes[i + 1] <= n)]
