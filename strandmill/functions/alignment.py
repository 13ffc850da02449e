"""Dynamic-programming alignments: bit-parallel, along the target, or of many pairs within a band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def infix_distance(query: str, target: str, cap: int | None = None) -> int | None:
    """Fewest edits that turn query into some stretch of target; None above cap.

    Columns of the table are two bit strings of differences down the query, one Python
    integer each, so a character of the target takes a few operations on whole columns.
    """
    m = len(query)
    if not m:
        return 0
    if cap is not None and cap < 0:
        return None
    where: dict[str, int] = {}
    for i, c in enumerate(query):
        where[c] = where.get(c, 0) | 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, best = ones, 0, m, m
    for left, c in zip(range(len(target) - 1, -1, -1), target, strict=True):
        eq = where.get(c, 0)
        diagonal = (((eq & rise) + rise) ^ rise) | eq | fall
        up, down = fall | (ones & ~(diagonal | rise)), rise & diagonal
        score += (1 if up & last else 0) - (1 if down & last else 0)
        up, down = up << 1 & ones, down << 1 & ones  # a stretch may start anywhere, so row 0 never rises
        rise, fall = down | (ones & ~(diagonal | up)), up & diagonal
        best = min(best, score)
        if best == 0 or (cap is not None and best > cap and score - left > cap):
            break
    return None if cap is not None and best > cap else best


def banded_alignments(queries: list[str], windows: list[str], shifts: list[int], band: int, match: int = 2, mismatch: int = -3, gap_open: int = -5, gap_extend: int = -2) -> list[tuple]:
    """Best local alignments with affine gaps within a band of diagonals, of all pairs at once.

    Diagonals are ``shift`` to ``shift + band - 1`` of each pair, a diagonal being a place of the window
    minus one of the query. Gives (score, identities, columns, q_start, q_end, t_start, t_end).
    """
    n, m = len(queries), max(map(len, queries), default=0)
    q, t = np.full((n, m), -1, np.int64), np.full((n, m + band), -2, np.int64)
    for i, (a, w, s) in enumerate(zip(queries, windows, shifts, strict=True)):
        q[i, : len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32)
        seen = np.frombuffer(w.encode("utf-32-le"), np.uint32)[max(s, 0) : max(s + m + band, 0)]
        t[i, max(-s, 0) : max(-s, 0) + len(seen)] = seen[: max(0, m + band - max(-s, 0))]
    low, at = -(1 << 30), np.arange(band) * gap_extend
    h, e = np.zeros((n, band), np.int64), np.full((n, band), low, np.int64)
    trace = np.zeros((m, n, band), np.uint8)  # bits: 1 diagonal, 2 query gap, 4 that gap starts here, 8 target gap starts here, 16 target gap
    best, row, column = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for i in range(m):
        straight = h + np.where(q[:, i : i + 1] == t[:, i : i + band], match, mismatch)
        opened, extended = np.full((n, band), low, np.int64), np.full((n, band), low, np.int64)
        opened[:, :-1], extended[:, :-1] = h[:, 1:] + gap_open, e[:, 1:] + gap_extend
        e = np.maximum(opened, extended)
        base = np.maximum(0, np.maximum(straight, e))
        f = np.full((n, band), low, np.int64)
        f[:, 1:] = (np.maximum.accumulate(base - at, axis=1) + at)[:, :-1] + gap_open
        first = np.zeros((n, band), bool)
        first[:, 1:] = f[:, 1:] == base[:, :-1] + gap_open
        h = np.maximum(base, f)
        trace[i] = np.where(base == 0, 0, np.where(base == straight, 1, 2)) | (opened >= extended) << 2 | first << 3 | (f > base) << 4
        most = h.max(1)
        new = most > best
        best[new], row[new], column[new] = most[new], i, h[new].argmax(1)
    i, c, mode = row.copy(), column.copy(), np.zeros(n, np.int64)  # modes: 0 any, 1 query gap, 2 target gap, 3 no target gap
    same, columns = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(best > 0)
    while len(live):
        here = trace[i[live], live, c[live]]
        mode[live[(mode[live] == 0) & (here & 16 > 0)]] = 2
        loose = np.isin(mode[live], (0, 3))
        mode[live[loose & (here & 3 == 2)]] = 1
        straight, stop = loose & (here & 3 == 1), loose & (here & 3 == 0)
        across, along = ~stop & (mode[live] == 1), ~stop & (mode[live] == 2)
        d, a, f = live[straight], live[across], live[along]
        same[d] += q[d, i[d]] == t[d, i[d] + c[d]]
        columns[live[~stop]] += 1
        i[d], mode[d] = i[d] - 1, 0
        i[a], c[a], mode[a] = i[a] - 1, c[a] + 1, np.where(here[across] & 4 > 0, 0, 1)
        c[f], mode[f] = c[f] - 1, np.where(here[along] & 8 > 0, 3, 2)
        live = live[~stop & (i[live] >= 0)]
    shift = np.array(shifts, np.int64)
    return list(zip(*[x.tolist() for x in (best, same, columns, i + 1, row + 1, i + 1 + c + shift, row + column + 1 + shift)], strict=True)) if n else []


def smith_waterman(query: str, target: str, match: int = 2, mismatch: int = -3, gap_open: int = -5, gap_extend: int = -2) -> int:
    """Best local score with affine gaps: the first gap character costs open, each further one extend."""
    t = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    n = len(t)
    h, e = np.zeros(n + 1, np.int64), np.full(n + 1, -(1 << 40), np.int64)
    at, best = np.arange(n + 1), 0
    for c in np.frombuffer(query.encode("utf-32-le"), np.uint32):
        e = np.maximum(e + gap_extend, h + gap_open)
        base = np.zeros(n + 1, np.int64)
        base[1:] = np.maximum(0, np.maximum(h[:-1] + np.where(t == c, match, mismatch), e[1:]))
        gaps = np.full(n + 1, -(1 << 40), np.int64)
        gaps[1:] = (np.maximum.accumulate(base - at * gap_extend) + at * gap_extend)[:-1] + gap_open
        h = np.maximum(base, gaps)
        h[0] = 0
        best = max(best, int(h.max()))
    return best


def infix_distance_udf():
    """infix_distance(query, target, cap) as an Arrow function; a null cap is none."""

    @F.arrow_udf("bigint")
    def run(q: pa.Array, t: pa.Array, cap: pa.Array) -> pa.Array:
        rows = zip(q.to_pylist(), t.to_pylist(), cap.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else infix_distance(a, b, c) for a, b, c in rows], pa.int64())

    return run
