"""Common k-mers of two blocks of texts, found by sorting numbers.

A block's texts lie end to end in one array of code points; a k-mer is one
number, the same in both blocks. Only the pairs of one run of left texts are
held at a time, so memory is bounded by ``ROWS`` however many pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from crossmer import constants as C

ROWS = 1 << 20          # common k-mers compared at a time
DENSE = 1 << 23         # slots for the pairs of one run of left texts
SLOTS = 1 << 25         # slots of the check whether the other block has a k-mer

_GROUP = np.zeros(128, dtype=np.uint32)      # code point -> reduced group, 0 for a non-residue
_RESIDUE = np.zeros(128, dtype=np.int64)
for _number, _members in enumerate(C.REDUCED_GROUPS.values(), 1):
    for _letter in _members:
        _GROUP[ord(_letter)] = _number
for _number, _letter in enumerate(C.MATRIX_ORDER):
    _RESIDUE[ord(_letter)] = _number
_SCORES = np.array([[C.blosum62()[x + y] for y in C.MATRIX_ORDER] for x in C.MATRIX_ORDER], dtype=np.int16)
_RUN_SCORES = _SCORES.astype(np.int64)
_LETTERS = len(C.MATRIX_ORDER)
_TWO_SCORES = (_SCORES[:, None, :, None] + _SCORES[None, :, None, :]).astype(np.int8).ravel()      # of two neighbours each


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, and the first place and length of each text among them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return points, np.cumsum(sizes) - sizes, sizes


def reduced(points: np.ndarray) -> np.ndarray:
    """Reduced group of every upper-case residue, 0 for anything else."""
    return _GROUP[np.where(points < 128, points, 0)]


def _numbers(points: np.ndarray, k: int) -> np.ndarray:
    """One number per place: equal where the next k code points are."""
    seen = np.zeros(int(points.max()) + 1 if len(points) else 1, dtype=bool)
    seen[points] = True
    letters = int(seen.sum())
    codes = (np.cumsum(seen) - 1)[points]
    count = max(len(points) - k + 1, 0)
    value, largest = codes[:count].copy(), letters
    for i in range(1, k):
        if largest * letters >= 1 << 62:
            distinct, value = np.unique(value, return_inverse=True)
            value, largest = value.astype(np.int64), len(distinct)
        value = value * letters + codes[i: i + count]
        largest *= letters
    return value


def _occurrences(value: np.ndarray, base: int, starts: np.ndarray, sizes: np.ndarray, k: int,
                 barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, k-mer, position) of every k-mer of every text, in order of text and position."""
    counts = np.maximum(sizes - k + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    position = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(starts, counts) + position
    if barred is not None:
        kept = barred[place + k] == barred[place]
        text, position, place = text[kept], position[kept], place[kept]
    return text, value[place + base], position


def _sorted(text: np.ndarray, kmer: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every occurrence, by k-mer, then text and position."""
    order = np.argsort(kmer, kind="stable")      # texts and positions ascend among equals
    return text[order], kmer[order], position[order]


def _distinct(text: np.ndarray, kmer: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first occurrence of every k-mer in every text, by k-mer, then text."""
    text, kmer, position = _sorted(text, kmer, position)
    first = np.ones(len(text), dtype=bool)
    first[1:] = (kmer[1:] != kmer[:-1]) | (text[1:] != text[:-1])
    return text[first], kmer[first], position[first]


def _windows(points: np.ndarray, sizes: np.ndarray, k: int, barred: int | None) -> np.ndarray:
    """Whether the k code points from a place are of one text and none is barred, for all places that k points follow."""
    whole = np.ones(max(len(points) - k + 1, 0), dtype=bool)
    ends = np.cumsum(sizes)
    for step in range(1, k):
        at = ends - step
        whole[at[(at >= 0) & (at < len(whole))]] = False
    if barred is not None:
        at = np.flatnonzero(points == barred)
        for step in range(k):
            whole[at[(at >= step) & (at - step < len(whole))] - step] = False
    return whole


def _present(kmer: np.ndarray) -> np.ndarray:
    """Slots of the k-mers; one that is not set tells that a k-mer is not among them."""
    present = np.zeros(SLOTS, dtype=bool)
    present[kmer & (SLOTS - 1)] = True
    return present


class Blocks:
    """K-mers that two blocks have in common; ``barred`` code points take no part in one.

    ``sides`` holds (text, k-mer, first position) of each text's common k-mers:
    left by text and position, right by k-mer. With ``every`` it holds all
    occurrences instead of the first ones.
    """

    def __init__(self, left, right, k: int, barred: int | None = None, every: bool = False):
        value = _numbers(np.concatenate((left[0], right[0])), k)
        bases = 0, len(left[0])
        whole = [_windows(own, sizes, k, barred) for own, _, sizes in (left, right)]
        numbers = [value[base: base + len(places)] for base, places in zip(bases, whole)]
        present = [_present(kmer[places]) for kmer, places in zip(numbers, whole)]
        found = []
        for i, (_, starts, _) in enumerate((left, right)):      # few pass where k-mers are rare
            place = np.flatnonzero(whole[i] & present[1 - i][numbers[i] & (SLOTS - 1)])
            text = np.searchsorted(starts, place, "right") - 1
            found.append((text, numbers[i][place], place - starts[text]))
        a, b = ((_sorted if every else _distinct)(*side) for side in found)
        self.left_texts, self.right_texts = len(left[2]), len(right[2])
        low = np.searchsorted(b[1], a[1], "left")
        matches = np.searchsorted(b[1], a[1], "right") - low
        order = np.lexsort((a[2], a[0]))
        order = order[matches[order] > 0]
        self.sides = [tuple(column[order] for column in a), b]
        self.low, self.matches = low[order], matches[order]

    def common(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of left texts: the first of them, and the left and right postings that meet.

        Left positions descend within a text. A run has about ``ROWS`` rows and
        its pairs fit into ``DENSE`` slots, or it is one text.
        """
        per_text = np.bincount(self.sides[0][0], weights=self.matches, minlength=self.left_texts)
        upto = np.concatenate(([0], np.cumsum(per_text)))
        bounds = np.searchsorted(self.sides[0][0], np.arange(self.left_texts + 1))
        most = max(1, DENSE // max(self.right_texts, 1))
        at = 0
        while at < self.left_texts:
            end = int(np.searchsorted(upto, upto[at] + ROWS, "right")) - 1
            end = min(max(end, at + 1), at + most, self.left_texts)
            rows = np.arange(bounds[at], bounds[end])[::-1]
            n = self.matches[rows]
            if len(rows):
                total = int(n.sum())
                inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                yield at, np.repeat(rows, n), np.repeat(self.low[rows], n) + inside
            at = end

    def rows(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """The left and right postings that meet, by left text, about ``ROWS`` at a time; true where a text is complete.

        Unlike those of common() a run may end within a text, or one of low
        complexity would meet all others at once.
        """
        text, upto = self.sides[0][0], np.cumsum(self.matches)
        at, rows = 0, len(text)
        while at < rows:
            end = max(int(np.searchsorted(upto, upto[at] - self.matches[at] + ROWS, "right")), at + 1)
            if end < rows and text[end] != text[at]:
                end = max(int(np.searchsorted(text, text[end])), at + 1)
            n = self.matches[at:end]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield end == rows or text[end] != text[end - 1], np.repeat(np.arange(at, end), n), np.repeat(self.low[at:end], n) + inside
            at = end


def _beside(points, starts, sizes, side, step: int, barred: int | None, none: int) -> np.ndarray:
    """Code point ``step`` places from every posting, ``none`` beyond the text or where it is barred."""
    text, _, position = side
    at = position + step
    inside = (at >= 0) & (at < sizes[text])
    found = points[np.where(inside, starts[text] + at, 0)].astype(np.int64) if len(points) else np.zeros(0, np.int64)
    return np.where(inside & (found != -1 if barred is None else found != barred), found, none)


def _marks_sorted(marks: np.ndarray) -> np.ndarray:
    """Rows (pair, diagonal, left position) in order: sorted as one number each where they fit."""
    if not marks.shape[1]:
        return marks
    low = marks.min(axis=1)
    bits = [int(span).bit_length() for span in marks.max(axis=1) - low]
    if sum(bits) > 63:
        return marks[:, np.lexsort((((marks[1] + (1 << 31)) << 31) | marks[2], marks[0]))]
    key = ((marks[0] - low[0]) << (bits[1] + bits[2])) | ((marks[1] - low[1]) << bits[2]) | (marks[2] - low[2])
    key.sort()
    return np.stack((
        (key >> (bits[1] + bits[2])) + low[0], ((key >> bits[2]) & ((1 << bits[1]) - 1)) + low[1], (key & ((1 << bits[2]) - 1)) + low[2]))


def _paired(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, diagonal, first start, start, last k-mer) of the longest run of each diagonal, the earliest of equals.

    ``starts`` and ``ends`` have rows (pair, diagonal, left position). Runs of one
    diagonal cannot overlap, so the n-th start belongs to the n-th end.
    """
    (pair, diagonal, start), end = _marks_sorted(starts), _marks_sorted(ends)[2]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1])
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    longest = np.flatnonzero(end - start == np.maximum.reduceat(end - start, at)[group])
    longest = longest[np.diff(group[longest], prepend=-1) > 0]
    return pair[at], diagonal[at], start[at], start[longest], end[longest]


def diagonal_runs(left: list[str], right: list[str], k: int, within: bool, barred: str | None = None,
                  alike: bool = False):
    """(left text, right text, length, left and right first, left and right start, score) of all diagonals with a common run.

    The longest common run of at least k residues of each diagonal, the earliest
    of equals, and where the first one begins. With ``alike`` residues of one
    reduced group are common; texts are upper-case then, and ``score`` sums the
    run's substitution scores. ``barred`` residues, or non-residues, take no part.
    """
    a, b = code_points(left), code_points(right)
    sides = [(reduced(p) if alike else p, starts, sizes) for p, starts, sizes in (a, b)]
    stop = 0 if alike else None if barred is None else ord(barred)
    blocks = Blocks(*sides, k, stop, every=True)
    (l_text, _, l_pos), (r_text, _, r_pos) = blocks.sides
    before, after = ([_beside(*own, side, step, stop, none) for own, side, none in zip(sides, blocks.sides, (-1, -2))]
                     for step in (-1, k))
    n = max(blocks.right_texts, 1)
    residues = [_RESIDUE[np.where(p < 128, p, 0)] for p, _, _ in (a, b)]
    starts, ends, held = [], [], 0
    for complete, i, j in blocks.rows():
        if within:
            kept = l_text[i] < r_text[j]
            i, j = i[kept], j[kept]
        for marks, (own, other) in ((starts, before), (ends, after)):
            edge = own[i] != other[j]
            x, y = i[edge], j[edge]
            marks.append(np.stack((l_text[x] * n + r_text[y], l_pos[x] - r_pos[y], l_pos[x])))
        held += starts[-1].shape[1]
        if held and complete and (held >= ROWS // 2):
            yield from _diagonals(starts, ends, k, n, a, b, residues, alike)
            starts, ends, held = [], [], 0
    if held:
        yield from _diagonals(starts, ends, k, n, a, b, residues, alike)


def _diagonals(starts, ends, k: int, n: int, a, b, residues, alike: bool):
    pair, diagonal, first, start, last = _paired(np.concatenate(starts, axis=1), np.concatenate(ends, axis=1))
    x, y, length = pair // n, pair % n, last - start + k
    score = np.zeros(len(x), dtype=np.int64)
    if alike:
        u, v, upto = a[1][x] + start, b[1][y] + start - diagonal, np.cumsum(length)
        at = 0
        while at < len(x):
            end = max(int(np.searchsorted(upto, upto[at] - length[at] + ROWS, "right")), at + 1)
            own = length[at:end]
            opens = np.cumsum(own) - own
            step = np.arange(int(own.sum())) - np.repeat(opens, own)
            values = _RUN_SCORES[residues[0][np.repeat(u[at:end], own) + step], residues[1][np.repeat(v[at:end], own) + step]]
            score[at:end] = np.add.reduceat(values, opens)
            at = end
    yield x, y, length, first, first - diagonal, start, start - diagonal, score


def best_of_pairs(x, y, length, l_first, r_first, l_start, r_start, score, n: int, first: bool):
    """(left text, right text, length, start in the left, in the right, score; the same from the right: right, left, score).

    Of diagonals in order of their pairs, the longest of each pair. Ties go to
    the smallest left place, then right, and for the right to the smallest right
    place, then left: where the diagonal's ``first`` run begins, or the longest.
    """
    pair = x * n + y
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes = np.diff(new, append=len(pair))
    longest = np.flatnonzero(length == np.repeat(np.maximum.reduceat(length, new), sizes)) if len(new) else new
    opens = np.flatnonzero(np.diff(pair[longest], prepend=-1))
    sizes = np.diff(opens, append=len(longest))
    places = (l_first, r_first) if first else (l_start, r_start)
    picked = []
    for own, other in (places, places[::-1]):
        key = (own[longest] << 31) | other[longest]
        picked.append(longest[key == np.repeat(np.minimum.reduceat(key, opens), sizes)] if len(opens) else longest)
    a, b = picked
    return x[a], y[a], length[a], l_start[a], r_start[a], score[a], r_start[b], l_start[b], score[b]


def common_owners(left: pa.ListArray, right: pa.ListArray):
    """A function of (left rows, right rows): whether the lists of a pair have an entry in common.

    Looks the entries of the shorter list up in the longer one, ``ROWS`` at a time.
    """
    values = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    code, codes = values.indices.to_numpy(), max(len(values.dictionary), 1)
    sizes = [np.asarray(side.value_lengths().fill_null(0)).astype(np.int64) for side in (left, right)]
    own = code[: int(sizes[0].sum())].astype(np.int64), code[int(sizes[0].sum()):].astype(np.int64)
    opens = [np.cumsum(n) - n for n in sizes]
    held = [np.sort(np.repeat(np.arange(len(n)), n) * codes + c) for n, c in zip(sizes, own)]

    def looked_up(rows, others, at: int) -> np.ndarray:
        """Whether an entry of side ``at`` is one of the other side's."""
        found = np.zeros(len(rows), dtype=bool)
        upto = np.cumsum(sizes[at][rows])
        first = 0
        while first < len(rows):
            n = sizes[at][rows[first]]
            last = max(int(np.searchsorted(upto, upto[first] - n + ROWS, "right")), first + 1)
            n = sizes[at][rows[first:last]]
            owner = np.repeat(np.arange(first, last), n)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            key = others[owner] * codes + own[at][opens[at][rows[owner]] + inside]
            place = np.minimum(np.searchsorted(held[1 - at], key), max(len(held[1 - at]) - 1, 0))
            if len(held[1 - at]):
                found[owner[held[1 - at][place] == key]] = True
            first = last
        return found

    single = [np.where(n == 1, np.append(c, 0)[np.minimum(o, len(c))], -1) for n, c, o in zip(sizes, own, opens)]

    def common(x, y) -> np.ndarray:
        found = (single[0][x] == single[1][y]) & (single[0][x] >= 0)
        many = np.flatnonzero((sizes[0][x] > 1) | (sizes[1][y] > 1))
        if len(many):
            shorter = sizes[0][x[many]] <= sizes[1][y[many]]
            for at, rows in ((0, many[shorter]), (1, many[~shorter])):
                ends = (x[rows], y[rows])
                found[rows] = looked_up(ends[at], ends[1 - at], at)
        return found

    return common


def shared_kmers(left: list[str], right: list[str], k: int, within: bool, barred: str | None = None):
    """(left text, right text, common k-mers) of every pair that shares one."""
    blocks = Blocks(code_points(left), code_points(right), k, None if barred is None else ord(barred))
    (l_text, _, _), (r_text, _, _) = blocks.sides
    n = max(blocks.right_texts, 1)
    for first, i, j in blocks.common():
        key = (l_text[i] - first) * n + r_text[j]
        if within:
            key = key[l_text[i] < r_text[j]]
        pair, shared = np.unique(key, return_counts=True)
        yield pair // n + first, pair % n, shared


def _seed_scores(left: np.ndarray, right: np.ndarray, k: int):
    """A function of (left places, right places): the substitution scores of k residues from there, two at a time."""
    one = [_RESIDUE[np.where(p < 128, p, 0)].astype(np.int32) for p in (left, right)]
    two = [codes * _LETTERS + np.append(codes[1:], codes[:1]) for codes in one]
    single, double = one[0] * _LETTERS, two[0] * _LETTERS ** 2

    def scores(u, v) -> np.ndarray:
        found = np.zeros(len(u), dtype=np.int16)
        for step in range(0, k - 1, 2):
            found += _TWO_SCORES[double[u + step] + two[1][v + step]]
        if k % 2:
            found += _SCORES.ravel()[single[u + (k - 1)] + one[1][v + (k - 1)]]
        return found

    return scores


def reduced_seeds(left: list[str], right: list[str], k: int, enough: float, within: bool):
    """(left text, right text, chained, left and right seed as seen from the left, enough; the same from the right).

    A seed is a common reduced k-mer; two adjacent ones on a diagonal are a
    chain. A pair's first seed, in the order of either end, is worth ``enough``
    or not by its substitution scores. Texts are upper-case.
    """
    a, b = code_points(left), code_points(right)
    groups = [(reduced(p), starts, sizes) for p, starts, sizes in (a, b)]
    chains = Blocks(*groups, k + 1, 0)
    chained_pairs = []
    for first, i, j in chains.common():
        x, y = chains.sides[0][0][i], chains.sides[1][0][j]
        key = np.unique(x * chains.right_texts + y)
        chained_pairs.append(key)
    chained_pairs = np.concatenate(chained_pairs) if chained_pairs else np.zeros(0, dtype=np.int64)
    blocks = Blocks(*groups, k, 0)
    (l_text, _, l_pos), (r_text, _, r_pos) = blocks.sides
    worth = _seed_scores(a[0], b[0], k)
    n = max(blocks.right_texts, 1)
    slot = np.empty(max(DENSE, n), dtype=np.int64)
    best = np.empty(max(DENSE, n), dtype=np.int64)
    for first, i, j in blocks.common():
        x, y = l_text[i], r_text[j]
        if within:
            kept = x < y
            i, j, x, y = i[kept], j[kept], x[kept], y[kept]
        key = (x - first) * n + y
        rows = np.arange(len(key))
        slot[key] = rows                              # the last row of a pair stays: its first left position
        won = slot[key] == rows
        pair = key[won]
        from_left = l_pos[i[won]], r_pos[j[won]]
        best[pair] = 1 << 62
        np.minimum.at(best, key, (r_pos[j] << 31) | l_pos[i])
        from_right = best[pair] & ((1 << 31) - 1), best[pair] >> 31
        x, y = x[won], y[won]
        at = np.searchsorted(chained_pairs, x * n + y)
        chained = np.zeros(len(x), dtype=bool)
        inside = at < len(chained_pairs)
        chained[inside] = chained_pairs[at[inside]] == (x * n + y)[inside]
        good = [chained.copy(), chained.copy()]
        u, v = a[1][x], b[1][y]
        rest = np.flatnonzero(~chained)
        good[0][rest] = worth(u[rest] + from_left[0][rest], v[rest] + from_left[1][rest]) >= enough
        good[1][rest] = good[0][rest]           # most pairs have one seed, the first from either end
        rest = rest[(from_left[0][rest] != from_right[0][rest]) | (from_left[1][rest] != from_right[1][rest])]
        good[1][rest] = worth(u[rest] + from_right[0][rest], v[rest] + from_right[1][rest]) >= enough
        yield x, y, chained, *from_left, good[0], *from_right, good[1]


def distinct_kmers(texts: list[str], k: int) -> tuple[np.ndarray, pa.Array]:
    """(text, k-mer) of every distinct k-mer of every text."""
    points, starts, sizes = code_points(texts)
    text, _, position = _distinct(*_occurrences(_numbers(points, k), 0, starts, sizes, k, None))
    place = starts[text] + position
    if len(points) and int(points.max()) >= 128:
        whole = "".join(texts)
        return text, pa.array([whole[at: at + k] for at in place.tolist()], pa.string())
    letters = np.ascontiguousarray(points.astype(np.uint8)[place[:, None] + np.arange(k)])
    offsets = np.arange(len(place) + 1, dtype=np.int32) * np.int32(k)
    return text, pa.StringArray.from_buffers(len(place), pa.py_buffer(offsets), pa.py_buffer(letters))


def overlaps(left: list[str], right: list[str], k: int) -> np.ndarray:
    """Jaccard index of the k-mer sets of every row's two texts, 0 where either is empty."""
    points, starts, sizes = code_points([*left, *right])
    text, kmer, _ = _occurrences(_numbers(points, k), 0, starts, sizes, k, None)
    order = np.lexsort((text, kmer, text % max(len(left), 1)))
    text, kmer = text[order], kmer[order]
    row = text % max(len(left), 1)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (kmer[1:] != kmer[:-1]) | (text[1:] != text[:-1])
    text, kmer, row = text[new], kmer[new], row[new]
    own = np.bincount(text, minlength=len(sizes))
    a, b = own[: len(left)], own[len(left):]
    twice = (kmer[1:] == kmer[:-1]) & (row[1:] == row[:-1])
    shared = np.bincount(row[1:][twice], minlength=len(left))
    return np.where((a > 0) & (b > 0), shared / np.maximum(a + b - shared, 1), 0.0)
