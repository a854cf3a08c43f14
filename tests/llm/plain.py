"""Plain versions of the operators, for small fixtures."""

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(texts):
    """The smallest position that links reach, for each text."""
    sets = [shingles(t) for t in texts]
    low = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    return low


def best_occurrence(item, text):
    """(least edit distance of the item's words to a stretch of the text's, all (begin, end) with it), by the full table."""
    a, b = words_of(item), words_of(text)
    best, out = len(a) + 1, []
    for begin in range(len(b) + 1):
        row = list(range(len(b) - begin + 1))
        rows = [row]
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b[begin:]):
                row.append(min(rows[-1][j] + (x != y), rows[-1][j + 1] + 1, row[j] + 1))
            rows.append(row)
        for size, d in enumerate(rows[-1]):
            if d < best:
                best, out = d, []
            if d == best:
                out.append((begin, begin + size))
    return best, out


def repeated_runs(texts, least=20):
    """The spans of words that line dedup deletes from each text (in order of doc_id): every window's minima, compared with every first place."""
    from millrace.llm.line_dedup import BESIDE, GRAM, WINDOW
    from millrace.llm.words import Words, long_grams, text_buffer

    docs = [words_of(t) for t in texts]
    data, offs = text_buffer(pa.array([t or "" for t in texts], pa.string()))
    hashed = Words(data, offs, 0, len(texts))
    marks = []
    for d, w in enumerate(docs):
        if len(w) < GRAM:
            marks += [(tuple(w), d, 0)] if w else []
            continue
        g = long_grams(hashed.hash[hashed.first[d] : hashed.first[d + 1]], GRAM).tolist()
        taken = set()
        for k in range(max(1, len(g) - WINDOW + 1)):
            low = min(g[k : k + WINDOW])
            taken |= {j for j in range(k, min(len(g), k + WINDOW)) if g[j] == low}
        marks += [(tuple(w[j : j + GRAM]), d, j) for j in sorted(taken)]
    first = {}
    for m, d, j in marks:
        first.setdefault(m, (d, j))
    spans = [[] for _ in docs]
    for m, d, j in marks:
        e, i = first[m]
        if (e, i) == (d, j):
            continue
        w, v, left, right = docs[d], docs[e], 0, 0
        while left < BESIDE and j - left > 0 and i - left > 0 and w[j - left - 1] == v[i - left - 1]:
            left += 1
        while right < BESIDE and j + len(m) + right < len(w) and i + len(m) + right < len(v) and w[j + len(m) + right] == v[i + len(m) + right]:
            right += 1
        spans[d].append((j - left, j + len(m) + right))
    out = []
    for w, own in zip(docs, spans, strict=True):
        merged = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append([(a, b) for a, b in merged if b - a >= least or b - a == len(w)])
    return out


def without_runs(text, spans):
    """The text without the spans of words; what follows a span stays with it."""
    if not spans:
        return text
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, pos = "", 0
    for a, b in spans:
        out += text[pos : at[a][0]]
        pos = at[b][0] if b < len(at) else len(text)
    return out + text[pos:]


def covered(texts, n):
    """Places (text, word) in n consecutive words that stand earlier."""
    seen, out = set(), set()
    for d, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                out |= {(d, x) for x in range(k, k + n)}
            seen.add(g)
    return out


def levenshtein(a, b):
    row = np.arange(len(b) + 1).tolist()
    for i, x in enumerate(a):
        new = [i + 1]
        for j, (p, q) in enumerate(pairwise(row)):
            new.append(min(p + (x != b[j]), q + 1, new[-1] + 1))
        row = new
    return row[-1]
