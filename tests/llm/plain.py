"""Plain versions of the operators' decisions: one document or pair at a time, nothing shared with the library but its fixed values."""

import hashlib
import re
from collections import Counter

import numpy as np

from plumbline.llm import leaks, mixing, quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_features(text):
    """The statistics in plain Python, one text at a time."""
    data = (text or "").encode()
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in WORD.findall(data)]
    raw = WORD.findall(data)
    lines_ = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in data.split(b"\n") if x]
    n, per_word, per_byte, n_lines = len(w), max(len(w), 1), max(len(data), 1), max(len(lines_), 1)
    mean = sum(map(len, w)) / per_word
    spread = max(sum(len(x) ** 2 for x in w) / per_word - mean**2, 0) ** 0.5
    triples = [tuple(w[i : i + 3]) for i in range(n - 2)]
    out = [np.log1p(len(data)), np.log1p(n), mean, spread, sum(c >= 128 for c in data) / per_byte, sum(65 <= x[0] <= 90 for x in raw) / per_word]
    out += [np.log1p(n_lines), n / n_lines, 1 - max(len(set(lines_)), 1) / n_lines, len(set(w)) / per_word]
    out += [1 - len(set(triples)) / max(n - 2, 1) if n > 2 else 0, max(Counter(w).values(), default=0) / per_word]
    return np.array(out + [sum(c in members for c in data) / per_word for members in quality.CLASSES.values()])


def plain_score(model, x):
    """One row down each tree, node by node."""
    raw = model.start
    for at in model.roots:
        for _ in range(model.depth):
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        raw += model.value[at]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def plain_alignment(a, b):
    """Smith-Waterman score of two word lists, cell by cell."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, max(row)), row
    return best


def bare_words(text):
    edge = ".,;:!?\"'()[]{}<>*#%&$|-_/\\~`^+=@"
    return [x.strip(edge) or x for x in text.lower().split()]


def is_leak(text, item):
    """Whether the alignment of a document with an item reaches the limits."""
    a, b = bare_words(text or ""), bare_words(item or "")
    if len(b) < leaks.SEED_WORDS or len(set(a) & set(b)) * 4 < leaks.MIN_SCORE * len(set(b)):  # a score of 0.4 needs at least 0.2 of the item's words
        return False
    score = plain_alignment(a, b)
    return score >= leaks.MIN_SCORE * 2 * len(b) and score >= 2 * min(leaks.MIN_MATCHED, len(b))


def brute_components(t, size=4, percent=85):
    """doc_id -> (shingles, least doc_id reachable by links), from all pairs."""
    sets = {}
    for i, x in t.items():
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in x))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in t}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(t)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = sorted((root(ids[a]), root(ids[b])))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in t}


def plain_mix(rows):
    """(doc_id, source, text) rows -> doc_ids in training order, as the documented targets and schedules have it."""
    size = {i: len(WORD.findall((x or "").encode())) for i, _, x in rows}
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    total = {n: sum(size[i] for i, s, _ in rows if s == n) for n in names}
    weight = {n: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, n in enumerate(names)}
    want, free, budget, target = sum(total.values()) * mixing.SHARE, list(names), 0.0, {}
    budget = want
    while free:  # fix sources at twice their size, share the rest by weight
        level = budget / sum(weight[n] for n in free)
        full = [n for n in free if level * weight[n] > mixing.MAX_REPEAT * total[n]]
        if not full:
            target |= {n: level * weight[n] for n in free}
            break
        for n in full:
            target[n] = mixing.MAX_REPEAT * total[n]
            budget -= target[n]
            free.remove(n)
    out = []
    for k, n in enumerate(names):
        knots, before = mixing.SCHEDULES[k % len(mixing.SCHEDULES)], 0
        grid = np.linspace(0, 1, 200_001)
        demand = np.cumsum(np.interp(grid, *zip(*knots)))
        demand = (demand - demand[0]) / (demand[-1] - demand[0])
        for i in sorted((i for i, s, _ in rows if s == n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            for epoch in range(mixing.MAX_REPEAT):
                middle = before + size[i] / 2 + epoch * total[n]
                if size[i] and middle < target[n]:
                    out.append((float(np.interp(middle / target[n], demand, grid)), i))
            before += size[i]
    return sorted(out)
