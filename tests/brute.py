"""Straightforward single-machine versions of the operators, for small fixtures."""

from __future__ import annotations

import math

from crossmer import constants as C

SCORES = C.blosum62()
GROUP = {r: g for g, members in C.REDUCED_GROUPS.items() for r in members}
LAM, K, H = C.KARLIN_ALTSCHUL[(9, 1)]


def sw(a, b, go=10, ge=1, unknown=-4):
    low = -10 ** 6
    above, gaps = [0] * (len(b) + 1), [low] * (len(b) + 1)
    best = end = 0
    for x in a:
        row, gap = [0] * (len(b) + 1), low
        for j, y in enumerate(b, 1):
            gap = max(gap - ge, row[j - 1] - go)
            gaps[j] = max(gaps[j] - ge, above[j] - go)
            row[j] = max(0, above[j - 1] + SCORES.get(x + y, unknown), gap, gaps[j])
            if row[j] > best:
                best, end = row[j], j
        above = row
    return best, end


def longest_run(a, b):
    best = (0, -1, -1)
    above = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = above[j] + 1
                if row[j + 1] > best[0]:
                    best = (row[j + 1], i, j)
        above = row
    return best


def kmer_set(s, k=6):
    return {s[i:i + k] for i in range(len(s) - k + 1)}


def chain(a, b, k=4):
    seeds = {(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1)
             if a[i:i + k] == b[j:j + k]}
    best = 0
    for i, j in seeds:
        n = 1
        while (i + n, j + n) in seeds:
            n += 1
        best = max(best, n)
    return best


def diagonal(q, t, k=5):
    """(chain, diagonal, start) as the diagonal filter picks them, or None."""
    rq, rt = ("".join(GROUP.get(c, "?") for c in s) for s in (q, t))
    diagonals = {}
    for i in range(len(rq) - k + 1):
        if "?" in rq[i:i + k]:
            continue
        for j in range(len(rt) - k + 1):
            if rq[i:i + k] == rt[j:j + k]:
                diagonals.setdefault(i - j, []).append(i)
    best = None
    for d, starts in diagonals.items():
        found, first, length = (0, 0), starts[0], 0
        for n, i in enumerate(starts):
            if n and i == starts[n - 1] + 1:
                length += 1
            else:
                first, length = i, 1
            if length > found[0]:
                found = (length, first)
        if best is None or found[0] > best[0]:
            best = (found[0], d, found[1])
    return best


def passes_diagonal(q, t):
    found = diagonal(q, t)
    if found is None:
        return False
    n, d, i = found
    if n >= 2:
        return True
    size = n + 4
    return sum(SCORES.get(q[i + x] + t[i - d + x], -4) for x in range(size)) / size >= 3.0


def effective(length, other):
    if length <= 0 or other <= 0:
        return max(length, 1)
    return max(int(length - math.log(K * length * other) / H), 1)


def evalue(score, m, db, batch=False):
    if score <= 0:
        return float(effective(m, db) * effective(db, m)) if batch else float(db * m)
    return K * effective(m, db) * effective(db, m) * math.exp(-LAM * score)


def screen_kmer(records, thr=0.01, min_aligned=8):
    db = sum(len(s) for _, s in records)
    out = {}
    for qi, q in records:
        for ti, t in records:
            if qi != ti and kmer_set(q) & kmer_set(t):
                score, end = sw(q, t)
                e = evalue(score, len(q), db)
                if e <= thr and end >= min_aligned:
                    out[qi, ti] = (score, end, e)
    return out


def screen_batch(records, thr=0.01, prefilter=True):
    db = sum(len(s) for _, s in records)
    order = sorted(records, key=lambda r: -len(r[1]))
    out = {}
    for n, (qi, q) in enumerate(order):
        for ti, t in order[n + 1:]:
            if prefilter and not passes_diagonal(q, t):
                continue
            score = sw(q, t, unknown=0)[0]
            run = longest_run(q, t)
            e = evalue(score, len(q), db, batch=True)
            if (e <= thr or run[0] >= 6) and t:
                out[qi, ti] = (score, run if run[0] >= 6 else (0, -1, -1), e)
    return out
