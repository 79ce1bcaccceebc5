"""Property-profile correlations for one Arrow batch of sequence pairs.

Profiles are exact integers (scale values times ten, window sums instead of
means); Pearson correlation does not change with scale, and flat stretches
then have a variance of exactly zero.
"""

from __future__ import annotations

import numpy as np

from crossmer import constants as C

_LETTERS = 1 << 18      # residues of the longer sequences that are slid along at a time


def _lookup(values: dict[str, int]) -> np.ndarray:
    table = np.zeros(256)
    for letter, value in values.items():
        table[ord(letter)] = table[ord(letter.lower())] = value
    return table


HYDROPATHY = _lookup(C.HYDROPATHY_X10)
CHARGE = _lookup(C.CHARGE_X10)
HYDROPHOBIC = _lookup(dict.fromkeys(C.HYDROPHOBIC, 1))


def _bytes(sequence: str) -> np.ndarray:
    return np.frombuffer(sequence.encode("latin-1", "replace"), dtype=np.uint8)


def window_sums(values: np.ndarray, window: int) -> np.ndarray:
    if len(values) < window:
        return np.zeros(0)
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[window:] - total[:-window]


def _pearson(n, sx, sxx, sy, syy, sxy) -> np.ndarray:
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    scale = np.sqrt(vx) * np.sqrt(vy)
    flat = (n < 2) | (vx <= 0) | (vy <= 0)
    return np.where(flat, 0.0, (n * sxy - sx * sy) / np.where(flat, 1.0, scale))


def pearson_pairs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pearson correlation of equal-length profiles that lie end to end."""
    ends = np.cumsum(sizes)

    def total(values):
        upto = np.concatenate(([0.0], np.cumsum(values)))
        return upto[ends] - upto[ends - sizes]

    return _pearson(sizes, total(left), total(left * left), total(right), total(right * right), total(left * right))


def max_cross_correlation(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Best Pearson correlation of the shorter profile slid along the longer one."""
    longer = [a if len(a) >= len(b) else b for a, b in zip(left, right)]
    shorter = [b if len(a) >= len(b) else a for a, b in zip(left, right)]
    sizes = np.array([len(x) for x in longer], dtype=np.int64)
    out = np.zeros(len(left))
    picked = np.flatnonzero([len(x) > 0 for x in shorter])
    upto = np.cumsum(sizes[picked])
    at = 0
    while at < len(picked):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + _LETTERS, "right")))
        rows = picked[at:end]
        out[rows] = _slide([longer[i] for i in rows], [shorter[i] for i in rows])
        at = end
    return out


def _slide(longer: list[np.ndarray], shorter: list[np.ndarray]) -> np.ndarray:
    """Sums of all windows of all pairs, one after the other; only the products need a call for every pair."""
    sizes = np.array([len(x) for x in longer], dtype=np.int64)
    n = np.array([len(x) for x in shorter], dtype=np.int64)
    windows = sizes - n + 1
    opens = np.cumsum(windows) - windows
    pair = np.repeat(np.arange(len(n)), windows)
    start = np.arange(len(pair)) + (np.cumsum(sizes) - sizes - opens)[pair]
    x, y = np.concatenate(longer), np.concatenate(shorter)
    upto, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x))
    first = np.cumsum(n) - n
    n_row = n[pair]
    stop = start + n_row
    r = _pearson(
        n_row, upto[stop] - upto[start], squares[stop] - squares[start],
        np.add.reduceat(y, first)[pair], np.add.reduceat(y * y, first)[pair],
        np.concatenate([np.correlate(a, b, "valid") for a, b in zip(longer, shorter)]),
    )
    return np.maximum(np.maximum.reduceat(r, opens), -1.0)


def profile_metrics(left_sequences, right_sequences) -> dict[str, np.ndarray]:
    """The five profile correlations of every pair, gap characters handled."""
    cache: dict[str, tuple] = {}

    def profiles(sequence: str):
        if sequence not in cache:
            codes = _bytes(sequence.replace("-", ""))
            cache[sequence] = (
                window_sums(HYDROPATHY[codes], C.PROFILE_WINDOW),
                window_sums(CHARGE[codes], C.PROFILE_WINDOW),
                HYDROPHOBIC[codes],
            )
        return cache[sequence]

    direct = [], []
    for a, b in zip(left_sequences, right_sequences):
        size = min(len(a), len(b))
        x, y = _bytes(a[:size]), _bytes(b[:size])
        if "-" in a or "-" in b:
            kept = (x != ord("-")) & (y != ord("-"))
            x, y = x[kept], y[kept]
        direct[0].append(x)
        direct[1].append(y)
    sizes = np.array([len(x) for x in direct[0]], dtype=np.int64)
    x, y = (np.concatenate([*side, np.zeros(0, dtype=np.uint8)]) for side in direct)
    pa = [profiles(s) for s in left_sequences]
    pb = [profiles(s) for s in right_sequences]
    return {
        "hydrophobicity_corr": pearson_pairs(HYDROPATHY[x], HYDROPATHY[y], sizes),
        "charge_corr": pearson_pairs(CHARGE[x], CHARGE[y], sizes),
        "hydrophobicity_cross_corr": max_cross_correlation([p[0] for p in pa], [p[0] for p in pb]),
        "charge_cross_corr": max_cross_correlation([p[1] for p in pa], [p[1] for p in pb]),
        "binary_hydro_cross_corr": max_cross_correlation([p[2] for p in pa], [p[2] for p in pb]),
    }


def residue_correlations(left: list[str], right: list[str], values: dict[str, int]) -> np.ndarray:
    """Pearson correlation of the residue values of every row's texts over their common length, 0 if either is flat."""
    table = np.zeros(128, dtype=np.int64)
    for letter, value in values.items():
        table[ord(letter)] = table[ord(letter.lower())] = value
    sizes = np.array([min(len(a), len(b)) for a, b in zip(left, right)], dtype=np.int64)
    scaled = []
    for side in (left, right):
        points = np.frombuffer("".join(t[:n] for t, n in zip(side, sizes)).encode("utf-32-le"), dtype=np.uint32)
        scaled.append(np.where(points < 128, table[np.where(points < 128, points, 0)], 0))
    x, y = scaled
    ends = np.cumsum(sizes)

    def total(numbers):
        upto = np.concatenate(([0], np.cumsum(numbers)))
        return upto[ends] - upto[ends - sizes]

    sx, sy = total(x), total(y)
    vx, vy = sizes * total(x * x) - sx * sx, sizes * total(y * y) - sy * sy
    flat = (sizes < 2) | (vx <= 0) | (vy <= 0)
    spread = np.sqrt(np.where(flat, 1, vx).astype(float)) * np.sqrt(np.where(flat, 1, vy).astype(float))
    return np.where(flat, 0.0, (sizes * total(x * y) - sx * sy) / spread)


def isoelectric_points(sequences: list[str | None]) -> np.ndarray:
    """pH of zero net charge by bisection on the seven residue counts, 7 for an empty sequence, 0 at the limit for none."""
    upper = [(s or "").upper() for s in sequences]
    ten = lambda x: 10.0 ** x
    counts = {x: np.array([s.count(x) for s in upper], dtype=float) for x in (*C.PKA_POSITIVE, *C.PKA_NEGATIVE)}
    low, high = np.zeros(len(upper)), np.full(len(upper), C.PH_MAX)
    for _ in range(C.PI_STEPS):
        middle = (low + high) / 2.0
        power = ten(middle)
        charge = 1.0 / (1.0 + power * ten(-C.PKA_N_TERMINUS)) - 1.0 / (1.0 + ten(C.PKA_C_TERMINUS) / power)
        for letter, pka in C.PKA_POSITIVE.items():
            charge += counts[letter] / (1.0 + power * ten(-pka))
        for letter, pka in C.PKA_NEGATIVE.items():
            charge -= counts[letter] / (1.0 + ten(pka) / power)
        above = charge > 0
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    found = (low + high) / 2.0
    found[[s == "" for s in sequences]] = C.NEUTRAL_PI
    found[[s is None for s in sequences]] = C.PH_MAX / 2 ** (C.PI_STEPS + 1)
    return found
