"""Affine-gap local alignment of many sequence pairs at once.

Called with one Arrow batch of pairs. The longer sequences of many pairs lie end
to end in one array, so that one NumPy instruction advances all of them by one
residue of the shorter sequences, without padding. Scores stand on a ramp that
falls by the cost of a gap and rises by more than any score from pair to pair:
the horizontal gap channel is then one running maximum, which no pair hands on
to the next.

Where identical runs are asked for, pairs are laid out column-wise instead, and
the horizontal channel is a prefix maximum computed by doubling; its reach is
limited by the best score so far, since a gap that costs more than the score it
starts from can never win.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from crossmer import constants as C

_PAD = len(C.MATRIX_ORDER) + 1
_SPAN = 32  # row stride of the lookup table
_PAD_SCORE = -100
_TILE_CELLS = 24_576
_LINE_CELLS = 1 << 16

_CODES = np.full(256, len(C.MATRIX_ORDER), dtype=np.int64)
for _index, _letter in enumerate(C.MATRIX_ORDER):
    _CODES[ord(_letter)] = _CODES[ord(_letter.lower())] = _index


@dataclass
class PairScores:
    score: np.ndarray        # best local score
    target_end: np.ndarray   # 1-based end in the target, first best cell in query order
    query_end: np.ndarray    # 1-based end in the query, first best cell in target order
    run: np.ndarray          # longest identical run
    run_query_end: np.ndarray   # 0-based, inclusive
    run_target_end: np.ndarray  # 0-based, inclusive


def substitution_table(unknown: int) -> np.ndarray:
    table = np.full((_SPAN, _SPAN), _PAD_SCORE, dtype=np.int16)
    n = len(C.MATRIX_ORDER)
    table[: n + 1, : n + 1] = unknown
    for pair, value in C.blosum62().items():
        table[C.MATRIX_ORDER.index(pair[0]), C.MATRIX_ORDER.index(pair[1])] = value
    return table.ravel()


def encode(sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All residues in one array, with start and length of every sequence."""
    lengths = np.fromiter((len(s) for s in sequences), dtype=np.int64, count=len(sequences))
    flat = _CODES[np.frombuffer("".join(sequences).encode("latin-1", "replace"), dtype=np.uint8)]
    return flat, np.cumsum(lengths) - lengths, lengths


def _columns(flat, starts, lengths, picked, height) -> np.ndarray:
    """(height, pairs) matrix of residue codes, padded below each sequence."""
    rows = np.arange(height)[:, None]
    inside = rows < lengths[picked][None, :]
    index = np.where(inside, rows + starts[picked][None, :], 0)
    return np.where(inside, flat[index], _PAD)


def align_pairs(
    queries,
    targets,
    gap_open: int = C.GAP_OPEN,
    gap_extend: int = C.GAP_EXTEND,
    unknown: int = C.UNKNOWN_SCORE,
    with_end: bool = True,
    run_from: int = 0,
) -> PairScores:
    """Scores of all pairs; ``run_from`` > 0 also finds identical runs that long."""
    total = len(queries)
    out = PairScores(*(np.zeros(total, dtype=np.int32) for _ in range(6)))
    if total == 0:
        return out
    sides = encode(queries), encode(targets)
    rows = np.arange(total)
    if run_from:
        _align(sides, rows, rows, gap_open, gap_extend, unknown, with_end, run_from, out)
        return out
    found = _in_lines(sides, rows, rows, substitution_table(unknown), gap_open, gap_extend, with_end)
    out.score[:], out.query_end[:], out.target_end[:] = found
    return out


def pair_scores(left, right, x: np.ndarray, y: np.ndarray, unknown: int) -> np.ndarray:
    """Best local scores of sequences ``x`` of one encoded set with sequences ``y`` of another."""
    return _in_lines((left, right), x, y, substitution_table(unknown), C.GAP_OPEN, C.GAP_EXTEND, False)[0]


def pair_ends(left, right, x: np.ndarray, y: np.ndarray, floor: np.ndarray, unknown: int) -> tuple[np.ndarray, ...]:
    """Score, left and right end as of align_pairs(); the ends only of pairs that reach their ``floor``."""
    return _in_lines((left, right), x, y, substitution_table(unknown), C.GAP_OPEN, C.GAP_EXTEND, True, floor)


def _in_lines(sides, x, y, table, gap_open, gap_extend, with_end, floor=None) -> tuple[np.ndarray, ...]:
    """(score, end in x in order of y, end in y in order of x) of all pairs."""
    (l_flat, l_starts, l_len), (r_flat, r_starts, r_len) = sides
    flat = np.concatenate((l_flat, r_flat))
    swapped = l_len[x] > r_len[y]       # one step of the loop per row: put the shorter sequence there
    own, other = (l_starts[x], l_len[x]), (r_starts[y] + len(l_flat), r_len[y])
    rows, columns = ([np.where(swapped, b, a) for a, b in zip(*ends)] for ends in ((own, other), (other, own)))
    table = table.reshape(_SPAN, _SPAN).astype(np.int32)

    def lines(picked, best=None):
        # the shortest last, since those that are through leave the line at its end
        picked = picked[np.argsort(-rows[1][picked], kind="stable")]
        upto = np.cumsum(columns[1][picked] + 1)
        at = 0
        while at < len(picked):
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + _LINE_CELLS, "right")))
            line = picked[at:end]
            yield line, _align_line(flat, *(c[line] for c in (*rows, *columns)), table, gap_open, gap_extend,
                                    with_end, None if best is None else best[line])
            at = end

    score, row, column = (np.zeros(len(x), dtype=np.int32) for _ in range(3))
    shared = np.zeros(len(x), dtype=bool)
    for line, (best, first_row, first_column, several) in lines(np.flatnonzero(rows[1] > 0)):
        score[line], row[line], column[line], shared[line] = best, first_row, first_column, several
    # what ends first in either order: rows and columns change places where the pair did
    ends = [np.where(swapped, column, row), np.where(swapped, row, column)]
    if with_end:
        again = np.flatnonzero(shared if floor is None else shared & (score >= floor))
        for line, (by_rows, by_columns) in lines(again, score):
            # row of the first best cell by columns, column of the first by rows
            turned = swapped[line]
            ends[0][line] = np.where(turned, by_rows, by_columns)
            ends[1][line] = np.where(turned, by_columns, by_rows)
    return score, *ends


def _align_line(flat, row_starts, row_len, column_starts, column_len, table, go, ge, with_end, known):
    """Aligns pairs whose columns lie end to end, longest rows first.

    Returns the best scores, the first row and the first column with a best
    cell, and whether several rows and columns have one. With ``known`` scores
    it returns the column of the first best cell by rows and the row of the
    first by columns.
    """
    pairs, sizes = len(row_len), column_len + 1     # a pad opens every pair's columns
    stops = np.cumsum(sizes)
    opens = stops - sizes
    pair = np.repeat(np.arange(pairs), sizes)
    place = np.arange(int(stops[-1])) - opens[pair]
    code = np.where(place > 0, flat[np.maximum(column_starts[pair] + place - 1, 0)], _PAD)
    index = code + pair * _SPAN
    most = 11 * row_len + go + ge + 1               # above any score of the pair
    ramp = (np.arange(len(pair)) * ge + (np.cumsum(most) - most)[pair]).astype(np.int32)
    table = table + np.int32(ge)                    # a diagonal step moves along the ramp
    above, vertical, peak = ramp.copy(), ramp.copy(), ramp.copy()
    spare, reach = np.empty_like(ramp), np.empty_like(ramp)
    best, first_row = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    rows_tie = np.zeros(pairs, dtype=bool)
    if known is not None:
        wanted, met = ramp + known.astype(np.int32)[pair], []
    scores = np.empty((pairs, _SPAN), np.int32)
    left = np.searchsorted(-row_len, -np.arange(int(row_len[0])), "left")
    for i, (live, size) in enumerate(zip(left.tolist(), stops[left - 1].tolist())):
        up, gap, cell, free = above[:size], vertical[:size], spare[:size], reach[:size]
        np.take(table, flat[row_starts[:live] + i], axis=0, out=scores[:live], mode="clip")
        np.take(scores.ravel(), index[:size], out=cell, mode="clip")
        np.add(cell[1:], up[:-1], out=cell[1:])

        # gap in the columns: continue or open from the row above
        np.subtract(gap, ge, out=gap)
        np.maximum(gap, up, out=gap)
        np.subtract(gap, go, out=free)
        np.maximum(cell, free, out=cell)
        np.maximum(cell, ramp[:size], out=cell)

        # gap in the rows: the best cell to the left less its gap cost
        np.maximum.accumulate(cell, out=free)
        np.subtract(free, go - ge, out=free)
        np.maximum(cell[1:], free[:-1], out=cell[1:])

        if known is not None:
            at = np.flatnonzero(cell == wanted[:size])
            met.append((np.full(len(at), i + 1), at))
        else:
            np.maximum(peak[:size], cell, out=peak[:size])
            if with_end:
                np.subtract(cell, ramp[:size], out=free)
                top, held = np.maximum.reduceat(free, opens[:live]), best[:live]
                more, same = top > held, top == held
                rows_tie[:live] = ~more & (rows_tie[:live] | same)
                first_row[:live][more] = i + 1
                np.maximum(held, top, out=held)
        above, spare = spare, above
    if known is not None:
        row, at = (np.concatenate(c) for c in zip(*met))
        firsts = []
        for value, order in ((place[at], np.lexsort((at, row))), (row, np.lexsort((row, at)))):
            _, first = np.unique(pair[at][order], return_index=True)
            firsts.append(value[order][first].astype(np.int32))
        return firsts
    np.subtract(peak, ramp, out=peak)
    score = np.maximum.reduceat(peak, opens)
    if not with_end:
        return score, 0, 0, False
    best_columns = np.flatnonzero((peak == score[pair]) & (peak > 0))
    owner, first, count = np.unique(pair[best_columns], return_index=True, return_counts=True)
    first_column, several = np.zeros(pairs, np.int32), np.zeros(pairs, dtype=bool)
    first_column[owner] = place[best_columns[first]]
    several[owner] = (count > 1) & rows_tie[owner]
    return score, first_row, first_column, several


def _align(sides, x, y, gap_open, gap_extend, unknown, with_end, run_from, out) -> None:
    table = substitution_table(unknown)
    q_len, t_len = sides[0][2][x], sides[1][2][y]
    swap = q_len > t_len  # one step of the loop per row: put the shorter sequence there
    for swapped in (False, True):
        picked = np.nonzero((q_len > 0) & (t_len > 0) & (swap == swapped))[0]
        (rows, i), (columns, j) = ((sides[1], y), (sides[0], x)) if swapped else ((sides[0], x), (sides[1], y))
        for tile in tiles(columns[2][j], rows[2][i], picked, _TILE_CELLS):
            longest = int(max(q_len[tile].max(), t_len[tile].max()))
            _align_tile(
                _columns(*rows, i[tile], int(rows[2][i[tile]].max())),
                _columns(*columns, j[tile], int(columns[2][j[tile]].max())),
                table.astype(np.int16 if fits_16_bits(longest, gap_open, gap_extend) else np.int32),
                gap_open, gap_extend, with_end, run_from, swapped, out, tile,
            )


def fits_16_bits(longest: int, gap_open: int, gap_extend: int) -> bool:
    """Scores, the gap ramp added to them and the decaying gap channel stay in range."""
    ramp = longest * gap_extend + gap_open
    return 11 * longest + ramp < 32_000 and ramp < 12_000


def tiles(wide: np.ndarray, tall: np.ndarray, picked: np.ndarray, cells: int):
    """Groups of pairs with similar sizes (little padding), ``cells`` values per row at most."""
    step = np.round(np.log(np.maximum(wide[picked], 1)) / np.log(1.3)).astype(np.int64)
    order = np.lexsort((tall[picked], step))
    picked, step = picked[order], step[order]
    sizes = tall[picked]
    first = 0
    while first < len(picked):
        last = int(np.searchsorted(step, step[first], side="right"))
        last = first + int(np.searchsorted(
            sizes[first:last], 1.3 * sizes[first] + 8, side="right"))
        last = min(last, first + max(16, int(cells / (1.15 * wide[picked[first]]))))
        yield picked[first:last]
        first = last


def _align_tile(q, t, table, go, ge, with_end, run_from, swapped, out, picked) -> None:
    dtype = table.dtype
    n, width = t.shape
    # row 0 of the score arrays is the empty prefix, so a diagonal step is a slice
    above = np.zeros((n + 1, width), dtype)
    here = np.zeros((n + 1, width), dtype)
    zero = np.zeros((n, width), dtype)
    vertical = np.full((n, width), -20_000, dtype)
    sub = np.empty((n, width), dtype)
    reach = np.empty((n, width), dtype)
    reach2 = np.empty((n, width), dtype)
    index = np.empty((n, width), np.int64)
    ramp = np.repeat((np.arange(n, dtype=dtype) * dtype.type(ge))[:, None], width, axis=1)
    ramp_open = ramp + dtype.type(go)
    best = np.zeros(width, dtype)
    row_major = np.zeros(width, np.int32)       # column of the first best cell by rows
    column_major = np.zeros((2, width), np.int32)  # row and column of the first by columns
    peak = np.zeros((n, width), dtype)
    if run_from:
        runs = np.zeros((n + 1, width), dtype)
        best_run = np.zeros(width, runs.dtype)
        run_row = np.zeros(width, np.int32)
        run_column = np.zeros(width, np.int32)
    q = q * _SPAN

    for i in range(q.shape[0]):
        np.add(t, q[i], out=index)
        np.take(table, index, out=sub, mode="wrap")

        # gap in the target sequence: continue or open from the row above
        np.subtract(vertical, dtype.type(ge), out=vertical)
        np.subtract(above[1:], dtype.type(go), out=reach)
        np.maximum(vertical, reach, out=vertical)

        cell = here[1:]
        np.add(above[:-1], sub, out=cell)
        np.maximum(cell, vertical, out=cell)
        np.maximum(cell, zero, out=cell)

        # gap in the query sequence: best cell to the left minus its gap cost
        top = int(cell.max())
        if top > go and n > 1:
            span_needed = n - 1 if ge == 0 else min(n - 1, (top - go - 1) // ge + 1)
            np.add(cell, ramp, out=reach)
            source, spare, span = reach, reach2, 1
            while span < span_needed:
                step = min(span, span_needed - span)
                np.maximum(source[step:], source[:-step], out=spare[step:])
                spare[:step] = source[:step]
                source, spare = spare, source
                span += step
            np.subtract(source, ramp_open, out=source)
            np.maximum(cell[1:], source[:-1], out=cell[1:])

        if with_end:
            row_best = cell.max(axis=0)
            level = np.nonzero((row_best >= best) & (row_best > 0))[0]
            if len(level):
                at = cell[:, level].argmax(axis=0) + 1
                better = row_best[level] > best[level]
                row_major[level[better]] = at[better]
                earlier = better | (at < column_major[1, level])
                column_major[0, level[earlier]] = i + 1
                column_major[1, level[earlier]] = at[earlier]
                best[level] = row_best[level]
        else:
            np.maximum(peak, cell, out=peak)

        if run_from:
            # identical standard residues are exactly the pairs scoring >= 4
            grown = runs[1:]
            np.add(runs[:-1], runs.dtype.type(1), out=reach)
            np.multiply(reach, sub >= 4, out=grown)
            row_run = grown.max(axis=0)
            longer = np.nonzero((row_run >= run_from) & (
                (row_run >= best_run) if swapped else (row_run > best_run)))[0]
            if len(longer):
                at = grown[:, longer].argmax(axis=0)
                if swapped:
                    # rows are target positions: a tie goes to the smaller query end
                    won = (row_run[longer] > best_run[longer]) | (at < run_column[longer])
                    longer, at = longer[won], at[won]
                best_run[longer] = row_run[longer]
                run_row[longer] = i
                run_column[longer] = at

        above, here = here, above

    out.score[picked] = best if with_end else peak.max(axis=0)
    out.target_end[picked] = column_major[0] if swapped else row_major
    out.query_end[picked] = row_major if swapped else column_major[0]
    if run_from:
        out.run[picked] = best_run
        out.run_query_end[picked] = run_column if swapped else run_row
        out.run_target_end[picked] = run_row if swapped else run_column
