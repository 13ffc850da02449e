"""Near-duplicate passages by compact windows of token min-hashes.

Tokens are hashes of word shingles. Under one hash function, all subsequences whose
smallest value is the same token form a compact window: the node of that token in the
Cartesian tree over the values. Passages have ``WINDOW`` tokens or more, so of each node
the subsequences of that length are kept: the runs of equal minima over sliding
windows, about 2n/WINDOW of them. The nodes of two functions are joined by interval:
where they overlap, all subsequences share both values, which is a key. There are
``FUNCTIONS`` // 2 such pairs. At a similarity of 0.8 a subsequence shares a pair's key
with a chance of 0.64, one of three with 0.95; longer passages have many subsequences.

Within the group of a key each run is linked with the smallest and the largest document
of the group, so these links are linear in runs. A link knows where the
shared minimum stands in both texts. Along that diagonal, passages are the runs of
windows with at least ``NEEDED`` equal tokens; links that lie in none of them are searched
by nearest places, which finds passages with words inserted or removed. The token sets
of the two passages must have a Jaccard similarity of 0.8 or more.

Runs that neither link joins to the others of their group are compared with all of the
group, in tiles of two blocks that a task holds (``_rest_of_groups``). Pairs already joined,
such as copies, aren't, and a tile gives no more rows than it joins runs. So any two runs of a
group that ``verify`` finds alike hang together by reported passages.

Windows that repeat exactly share all three keys. Those that no passage covers yet are
grouped by a hash of the whole window and linked with the smallest and the largest
document of that group, so every word sequence of PASSAGE_WORDS words that two documents
share lies in a reported passage of both of them.

Defined results: texts with fewer words than a passage give no rows, nor do null or
empty ones and rows with a null doc_id. Repeats inside one document alone don't count.
Repeated rows of a doc_id count as that document, with the smallest text. An empty table
gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch, gram_hashes, join_spread, lower, mix, sized, span_hashes, table, text_chunks, words

SHINGLE, PASSAGE_WORDS, FUNCTIONS, LONGEST = 5, 50, 6, 16_384
WINDOW = PASSAGE_WORDS - SHINGLE + 1
#: Tokens of a window that must match for a Jaccard similarity of 0.8 of equally long sets: 2 * 0.8 / 1.8.
NEEDED = int(np.ceil(WINDOW * 1.6 / 1.8))
SIMILARITY = 0.8
#: Runs of a block, two of which a tile compares, and of the tiles that are dealt to one call, about.
TILE, BUNCH = 256, 4096


def sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive entries."""
    done = 1
    while done < size:
        more = min(done, size - done)
        v = np.minimum(v[:-more], v[more:])
        done += more
    return v


def compact_windows(tokens: np.ndarray, valid: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key with the pair of functions in its low 2 bits, first window, last window and place of the first function's minimum, over all pairs.

    valid and row: of each window start. A run shares the minima of both functions, and the place of the first one's.
    """
    out = []
    inner = np.ones(len(row), bool)
    inner[1:] = (row[1:] != row[:-1]) | ~valid[:-1]
    for pair in range(FUNCTIONS // 2):
        values = [mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (2 * pair + k + 1) % 2**64)) for k in (0, 1)]
        least = [sliding_min(v, WINDOW) for v in values]
        starts = inner | np.concatenate([[True], (least[0][1:] != least[0][:-1]) | (least[1][1:] != least[1][:-1])])
        starts[::LONGEST] = True  # longer runs are split
        starts &= valid
        ends = np.ones(len(valid), bool)
        ends[:-1] = starts[1:] | ~valid[1:]
        ends &= valid
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        # the first place at or after the run's start that has the minimum lies in all of its windows or in its first one
        order = np.flatnonzero(_is_minimum(values[0], least[0]))
        at = order[np.minimum(np.searchsorted(order, first), max(len(order) - 1, 0))]
        while len(wrong := np.flatnonzero(values[0][at] != least[0][first])):
            at[wrong] = order[np.minimum(np.searchsorted(order, at[wrong] + 1), len(order) - 1)]
        key = mix(least[0][first] * np.uint64(0xD6E8FEB86659FD93) + least[1][first])
        out.append((key & np.uint64(0xFFFFFFFFFFFFFFFC) | np.uint64(pair), first, last, at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _is_minimum(v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which entries are the minimum of a window that has them."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    n = len(padded) - WINDOW + 1
    highest = ~sliding_min(~padded, WINDOW)[:n]
    return highest[: len(v)] == v


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, offsets in text_chunks(batch.column("text")):
            data = lower(data)
            starts, ends, first = words(data, offsets)
            if len(starts) < PASSAGE_WORDS:
                continue
            tokens = gram_hashes(span_hashes(data, starts, ends), SHINGLE)
            n = len(tokens) - WINDOW + 1
            row = np.repeat(np.arange(b - a), np.diff(first))
            valid = row[:n] == row[PASSAGE_WORDS - 1 : PASSAGE_WORDS - 1 + n]
            key, lo, hi, at = compact_windows(tokens, valid, row[:n])
            of = row[lo]
            place = (lo - first[of]).astype(np.int64) << 23 | (hi - lo + WINDOW - 1) << 8 | (at - lo) << 2 | (key & np.uint64(3)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.slice(a, b - a).take(pa.array(of)), pa.array(place)], ["key", "doc_id", "place"])


def places(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last token of a run, where its minimum stands, and the pair of functions, from one long each: 15 bits of length, 6 of the minimum, 2 of the pair."""
    first = packed >> 23
    return first, first + (packed >> 8 & 0x7FFF), first + (packed >> 2 & 63), packed & 3


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each token; equal places that agree by chance are one in four billion."""
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, offsets in text_chunks(batch.column("text")):
            data = lower(data)
            starts, ends, first = words(data, offsets)
            tokens = (gram_hashes(span_hashes(data, starts, ends), SHINGLE) >> np.uint64(32)).astype(np.uint32)
            held = [tokens[i : max(i, j - SHINGLE + 1)].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(held, pa.binary())], ["doc_id", "tokens"])


def _covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places the intervals lo to hi (inclusive) cover; some may be empty or lie behind."""
    real = (hi >= lo) & (lo < n)
    lo, hi = lo[real], hi[real]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(hi + 1, n), -1)
    return np.cumsum(change[:n]) > 0


def along_diagonals(one: np.ndarray, two: np.ndarray, links: np.ndarray) -> tuple[dict, np.ndarray]:
    """Passages {(start, end, start in two, end in two): similarity} in words along the links' shifts, and the links that lie in none.

    links: rows of l, r and place of the minimum in one, then in two.
    """
    out: dict = {}
    left = np.ones(len(links), bool)
    shift = links[:, 5] - links[:, 2]
    for s in np.unique(shift):
        i, j = max(0, -s), min(len(one), len(two) - s)
        if j - i < WINDOW:
            continue
        same = one[i:j] == two[i + s : j + s]
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= NEEDED)
        if not len(good):
            continue
        own = np.flatnonzero(shift == s)
        place = links[own, 2] - i
        cuts = np.flatnonzero(np.diff(good) > WINDOW - 1) + 1
        for a, b in zip(good[np.concatenate([[0], cuts])], good[np.concatenate([cuts - 1, [-1]])] + WINDOW, strict=True):
            met = own[(place >= a) & (place < b)]
            if not len(met):
                continue
            hit = np.flatnonzero(same[a:b])
            p, q = int(a + hit[0] + i), int(a + hit[-1] + i + 1)
            if len(hit) == q - p:
                similarity = 1.0
            else:
                x, y = np.unique(one[p:q]), np.unique(two[p + s : q + s])
                both = len(np.intersect1d(x, y, assume_unique=True))
                similarity = both / (len(x) + len(y) - both)
            if similarity >= SIMILARITY:
                out[p, q + SHINGLE - 1, int(p + s), int(q + s + SHINGLE - 1)] = similarity
                left[met] = False
    return out, links[left]


def _points(one: np.ndarray, two: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in one, ascending, and their places in two: of the places of a token, the nearest to the one a link leads to."""
    n, m = len(one), len(two)
    la, ra = links[:, 0], np.minimum(links[:, 1], n - 1)
    size = ra - la + 1
    shift = links[:, 5] - links[:, 2]
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - la, size)
    known = np.unique(i * (m + 1) + np.clip(i + np.repeat(shift, size), 0, m))
    i, target = known // (m + 1), known % (m + 1)
    order = np.argsort(two, kind="stable")
    kinds, rank = np.unique(two[order], return_inverse=True)
    keys = rank * (m + 1) + order
    own = np.minimum(np.searchsorted(kinds, one[i]), len(kinds) - 1)
    i, target, own = (x[kinds[own] == one[i]] for x in (i, target, own))
    at = np.searchsorted(keys, own * (m + 1) + target)
    above, below = np.minimum(at, m - 1), np.maximum(at - 1, 0)
    up = np.where(rank[above] == own, np.abs(order[above] - target), m + 1)
    down = np.where(rank[below] == own, np.abs(order[below] - target), m + 1)
    place = np.where(up < down, order[above], order[below])
    known = np.unique((i * (m + 1) + place)[np.minimum(up, down) <= 2 * WINDOW])
    return known // (m + 1), known % (m + 1)


def _filled(one: np.ndarray, two: np.ndarray, links: np.ndarray) -> bool:
    """Whether a window of one has NEEDED tokens within the links' extents that two has; nearest places find no passage otherwise."""
    order = np.sort(two)
    hit = (order[np.minimum(np.searchsorted(order, one), len(order) - 1)] == one) & _covered(len(one), links[:, 0], links[:, 1])
    sums = np.concatenate([[0], np.cumsum(hit)])
    return bool((sums[WINDOW:] - sums[:-WINDOW]).max() >= NEEDED)


def verify(one: np.ndarray, two: np.ndarray, links: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages (start and end word in one, in two, similarity). links: rows of l, r and place of the minimum in one, then in two.

    What isn't found along the diagonals is searched by nearest places. A run of matching
    windows that isn't one passage is split where its shift (place in two less position
    in one) jumps, else in halves that overlap by a window, down to single windows.
    Matches off a passage's shift are searched for further passages.
    """
    n = len(one)
    if n < WINDOW or len(two) < WINDOW:
        return []
    out, links = along_diagonals(one, two, links)
    if not len(links) or not _filled(one, two, links):
        return [(*k, s) for k, s in sorted(out.items())]
    todo = [_points(one, two, links)]
    while todo:
        at, to = todo.pop()
        if len(at) < NEEDED:
            continue
        low, high = max(0, int(at[0]) - WINDOW + NEEDED), min(n, int(at[-1]) + 1 + WINDOW - NEEDED)
        same = np.zeros(high - low, np.int64)
        same[at - low] = 1
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= NEEDED) + low
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
            own = slice(np.searchsorted(at, run[0]), np.searchsorted(at, run[-1] + WINDOW))
            hit, place = at[own], to[own]
            i, j, shift = int(hit[0]), int(hit[-1]), place - hit
            kept = np.abs(shift - np.sort(shift)[len(shift) // 2]) <= max(16, (j - i) // 4)  # an entry of shift, so one at least is kept
            p, q = int(place[kept].min()), int(place[kept].max())
            left, right = np.unique(one[i : j + 1]), np.unique(two[p : q + 1])
            both = len(np.intersect1d(left, right, assume_unique=True))
            similarity = both / (len(left) + len(right) - both)
            if min(j - i, q - p) + 1 < NEEDED:  # few tokens again and again, which the exact windows cover
                continue
            if similarity >= SIMILARITY:
                out[i, j + SHINGLE, p, q + SHINGLE] = similarity
                todo.append((hit[~kept], place[~kept]))
                continue
            shifts = np.unique(shift)
            jumps = np.diff(shifts)
            widest = int(jumps.max()) if len(jumps) else 0
            if widest > 16 or (widest > 1 and j - i < WINDOW):
                part = np.searchsorted(shifts[1:][jumps > widest // 2], shift, "right")
                todo += [(hit[part == k], place[part == k]) for k in range(int(part.max()) + 1)]
            elif j - i >= WINDOW:
                middle = (i + j) // 2
                for half in (hit <= middle + WINDOW // 2 - 1, hit >= middle - WINDOW // 2 + 1):
                    todo.append((hit[half], place[half]))
    return [(*k, s) for k, s in sorted(out.items())]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages, and as rows with a key the links (doc_id, start_word: place; other_id, other_start: place) that lie in none."""
    for batch in batches:
        rows = []
        lists = batch.column("links")
        flat = lists.flatten()
        packed = [flat.field(c).to_numpy() for c in ("key", "x", "y")]
        linked = np.column_stack([x for c in packed[1:] for x in places(c)[:3]])
        ends = np.cumsum(lists.value_lengths().to_numpy())
        begin = [batch.column(c).to_numpy().astype(np.int64) for c in ("from_a", "from_b")]
        sizes = np.diff(ends, prepend=0)
        linked -= np.column_stack([np.repeat(x, sizes) for x in begin for _ in range(3)])
        ids = [x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in (batch.column("a"), batch.column("b"), *begin)]
        for k, (a, b, v, w) in enumerate(zip(*ids, strict=True)):
            one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in ("tokens_a", "tokens_b"))
            own = slice(ends[k - 1] if k else 0, ends[k])
            links, left = linked[own], np.ones(sizes[k], bool)
            for i, j, p, q, s in verify(one, two, links):
                rows += [(*x, None) for x in _both_ways(a, i + v, j + v, b, p + w, q + w, s)]
                left &= ~((links[:, 2] >= i) & (links[:, 2] < j) & (links[:, 5] >= p) & (links[:, 5] < q))
            rows += [(a, x, None, b, y, None, None, g) for g, x, y in zip(*(c[own][left].tolist() for c in packed), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays(*_columns(rows, batch.schema.field("a").type))


def _both_ways(a, i, j, b, p, q, s) -> list[tuple]:
    return [(a, i, j, b, p, q, s), (b, p, q, a, i, j, s)]


def _columns(rows: list[tuple], kind: pa.DataType) -> tuple[list[pa.Array], list[str]]:
    """Columns of passages, with key if the rows have one, and their names."""
    names = ["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "similarity", "key"][: len(rows[0])]
    kinds = [kind, pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names


def _classes(slices: list[np.ndarray], links: np.ndarray, kinds: np.ndarray, caps: tuple[int, int] | None) -> list[tuple]:
    """A name for each token slice; ``verify`` gives the same, but for shifts, for slices of one name against any made of kinds.

    It has what lies between the first and the last token of kinds, where the minimum stands, and how much room is around, as far as that counts:
    the run's extent or, for slices that come second, what stays free of clipping beyond caps.
    """
    out = []
    for x, (l, r, at) in zip(slices, links.tolist(), strict=True):
        inside = np.flatnonzero(kinds[np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)] == x) if len(kinds) else np.zeros(0, np.int64)
        if not len(inside):
            out.append(())
            continue
        i, j = int(inside[0]), int(inside[-1]) + 1
        room = (min(i, WINDOW), min(len(x) - j, WINDOW)) if caps is None else (min(i, WINDOW - NEEDED), min(len(x) - j, WINDOW - NEEDED), min(at, caps[0]), min(len(x) - at, caps[1]))
        out.append((x[i:j].tobytes(), at - i, *room, *((l - at, r - at) if caps is None else ())))
    return out


def _alike(one: list[np.ndarray], links: np.ndarray, two: list[np.ndarray], other_at: np.ndarray, kinds: np.ndarray):
    """For each token slice of the one its number, those of the other with which ``verify`` may find passages and how much they share.

    It finds none without a window around the minimum that has NEEDED equal tokens where the minima stand on each other or, within
    the run's extent, NEEDED tokens in a window that the other slice has anywhere. Both are counted for all other slices at once.
    """
    size = [len(x) for x in two]
    flat, of = np.concatenate(two), np.repeat(np.arange(len(two)), size)
    code = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
    known = np.flatnonzero(kinds[code] == flat)
    code, of = code[known], of[known]
    has = np.zeros((len(kinds) + 1, len(two)), bool)  # by tokens of both sides, the last for all others
    has[code, of] = True
    center = max(int(links[:, 2].max()), int(other_at.max()))
    aligned = np.full((center + max(max(len(x) - at for x, at in zip(one, links[:, 2].tolist(), strict=True)), int((size - other_at).max())), len(two)), -1, np.int32)
    aligned[(known - (np.cumsum(size) - size)[of]) + center - other_at[of], of] = code  # minima in one row

    def most(hits: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(hits) + 1, hits.shape[1]), np.int32)
        np.cumsum(hits, axis=0, out=sums[1:])
        return (sums[WINDOW:] - sums[:-WINDOW]).max(0)

    def full(hits: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(np.count_nonzero(hits, axis=0) >= NEEDED)
        return some[most(hits[:, some]) >= NEEDED] if len(some) else some

    for i, (x, (l, r, at)) in enumerate(zip(one, links.tolist(), strict=True)):
        own = np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
        own = np.where(kinds[own] == x, own, len(kinds))
        if len(x) < WINDOW or np.count_nonzero(own < len(kinds)) < NEEDED:
            continue
        low, high = max(0, at - WINDOW + 1), min(len(x), at + WINDOW)  # windows that hold the minimum
        near = full(aligned[center - at + low : center - at + high] == own[low:high, None])
        inside = own[l : r + 1]
        if np.count_nonzero(inside < len(kinds)) >= NEEDED:
            near = np.union1d(near, full(has[inside]))
        if len(near):
            yield i, near.tolist(), most(has[own][:, near]).tolist()


#: Doc ids, parts, first tokens, links and tokens of runs.
_Side = tuple[list, list[int], list[int], np.ndarray, list[np.ndarray]]


def _side(t: pa.Table) -> _Side:
    tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("tokens")]
    begin = t.column("begin").to_numpy()
    link = np.column_stack([x - begin for x in places(t.column("place").to_numpy())[:3]])
    return t.column("doc_id").to_pylist(), t.column("part").to_pylist(), begin.tolist(), link, tokens


def _join_tiles(left: pa.Table, right: pa.Table) -> list[tuple]:
    """``_join_tile`` for every tile that both tables have rows of."""
    by, sides = ["key", "k1", "b1", "k2", "b2"], []
    for t in (left, right):
        t = t.sort_by([(c, "ascending") for c in by]).combine_chunks()
        names = np.column_stack([t.column(c).to_numpy() for c in by])
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
        sides.append((_side(t), {tuple(names[a].tolist()): slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}))
    (one, own), (two, other) = sides
    return [row for key, s in own.items() if key in other for row in _join_tile(key, tuple(x[s] for x in one), tuple(x[other[key]] for x in two))]


def _join_tile(key: tuple, left: _Side, right: _Side) -> list[tuple]:
    """Passages that join runs of two blocks of a group. Runs of equal ``part`` hang together already; each passage joins two parts."""
    same = key[1:3] == key[3:5]
    # runs that hang together come second
    (ids, part, begin, link, one), (other_ids, other_part, other_begin, other_link, two) = (left, right) if key[1] == key[3] else (right, left)
    kinds = np.intersect1d(np.concatenate(one), np.concatenate(two))
    if not len(kinds):
        return []
    names: tuple[list, list] | None = None  # of the slices of both sides, of tiles that need them
    root: dict = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    rows, unlike = [], set()
    for i, near, most in _alike(one, link, two, other_link[:, 2], kinds):
        if names is None:
            caps = int((link[:, 2] - link[:, 0]).max()) + 1, int((link[:, 1] - link[:, 2]).max()) + 1
            names = _classes(one, link, kinds, None), _classes(two, other_link, kinds, caps)
        first: dict = {}
        for j in near:
            first.setdefault(names[1][j], j)
        for _, _, j in sorted((-n, first[names[1][j]], j) for j, n in zip(near, most, strict=True)):
            a, b, kind = ids[i], other_ids[j], (names[0][i], names[1][j])
            if kind in unlike or a == b or (same and a > b) or (x := top(part[i])) == (y := top(other_part[j])):
                continue
            met = verify(one[i], two[j], np.concatenate([link[i], other_link[j]])[None, :])
            if met:
                root[y] = x
            else:
                unlike.add(kind)
            v, w = begin[i], other_begin[j]
            for s, e, p, q, similarity in met:
                rows += _both_ways(a, s + v, e + v, b, p + w, q + w, similarity)
    return rows


def _exact_batches(only_open: bool):
    """(h, doc_id, at): hash and place of the windows that lie in runs of every pair of functions, or of those that no passage covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[k].as_buffer(), np.uint32)
                n = len(tokens) - WINDOW + 1
                lo, hi, _, pair = places(batch.column("runs")[k].values.to_numpy())
                inside = np.ones(n, bool)
                for x in range(FUNCTIONS // 2):
                    inside &= _covered(n, lo[pair == x], hi[pair == x] - WINDOW + 1)
                known = batch.column("passages")[k].values if only_open else None
                if known is not None:
                    inside &= ~_covered(n, known.field("s").to_numpy(), known.field("e").to_numpy() - PASSAGE_WORDS)
                at = np.flatnonzero(inside)
                if len(at):
                    h = _whole_windows(tokens)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(pa.array(np.full(len(at), k))), pa.array(at)], ["h", "doc_id", "at"])

    return run


def _whole_windows(tokens: np.ndarray) -> np.ndarray:
    """A hash of every WINDOW consecutive tokens: doubled spans, as in a sparse table."""
    h, size = mix(tokens.astype(np.uint64)), 1
    whole = np.zeros(len(tokens) - WINDOW + 1, np.uint64)
    at, left = 0, WINDOW
    while left:
        if left & 1:
            whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + h[at : at + len(whole)])
            at += size
        left >>= 1
        if left:
            h, size = mix(h[: len(h) - size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]), 2 * size
    return whole


def _with_tokens(pairs: DataFrame, tokens: DataFrame, key: str, other: str, side: str, scratch: Scratch) -> DataFrame:
    """pairs with the tokens of one document, cut to what its links span and a window on both sides."""
    joined = join_spread(pairs, tokens.select(F.col("doc_id").alias(key), "tokens"), key, other, scratch, f"pairs_{key}")
    first = F.greatest(F.shiftright(F.array_min(F.transform("links", lambda z: z[side])), 23) - WINDOW, F.lit(0)).cast("int")
    last = F.array_max(F.transform("links", lambda z: F.shiftright(z[side], 23) + F.shiftright(z[side], 8).bitwiseAND(0x7FFF)))
    size = (last + WINDOW + 1 - F.col(f"from_{key}")).cast("int")
    return joined.withColumn(f"from_{key}", first).withColumn(f"tokens_{key}", F.substring("tokens", F.col(f"from_{key}") * 4 + 1, size * 4)).drop("tokens")


def _rest_of_groups(runs: DataFrame, reps: DataFrame, failed: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages that join runs of a group which the links to its smallest and largest document, the representatives, leave apart.

    failed: links (doc_id, start_word, other_id, other_start, key) that no passage holds. A run is
    of kind 0 if it hangs together with the one representative, 1 with the other only, 2 with neither. Blocks
    are of one kind; those of kind 0 or 1 aren't compared with their like.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    side = lambda doc, place, bit: failed.select("key", F.col(doc).alias("doc_id"), F.col(place).alias("place"), F.lit(bit).alias("bit"))
    bits = scratch.save(side("other_id", "other_start", 1).unionByName(side("doc_id", "start_word", 2)).groupBy("key", "doc_id", "place").agg(F.bit_or("bit").alias("bits")), "bits")
    asked = scratch.save(bits.select("key").distinct(), "unjoined")
    own, rep = F.col("doc_id"), F.col("place")
    within = runs.join(sized(asked), "key").join(reps, "key").where(~((own == F.col("lo")) & (rep == F.col("lo_place"))) & ~((own == F.col("hi")) & (rep == F.col("hi_place"))))
    within = within.join(bits, ["key", "doc_id", "place"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    no_lo, no_hi = (F.col("bits").bitwiseAND(b) > 0 for b in (1, 2))
    no_lo, no_hi = no_lo | (own == F.col("lo")), no_hi | (own == F.col("hi"))  # a document isn't linked with itself
    within = scratch.save(within.select("key", "doc_id", "place", F.when(~no_lo, F.when(~no_hi, 3).otherwise(0)).otherwise(F.when(~no_hi, 1).otherwise(2)).alias("kind")), "within")
    # kind 3 hangs together with both, so that 0, 1 and 3 are one
    sizes = within.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.max("kind") == 3).alias("one"), *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)]).where("least <> most")
    of = lambda n: F.ceil(n / TILE).cast("int")
    total = F.when(F.col("one"), F.col("n0") + F.col("n1") + F.col("n3"))
    sizes = sizes.select("key", "one", F.array(of(F.coalesce(total, F.col("n0"))), of(F.when(F.col("one"), 0).otherwise(F.col("n1"))), of(F.col("n2"))).alias("blocks"))
    sizes = sizes.where((F.col("blocks")[2] > 0) | ((F.col("blocks")[0] > 0) & (F.col("blocks")[1] > 0)))
    sizes = scratch.save(sizes, "sizes")
    dealt = within.join(sizes, "key").withColumn("kind", F.when((F.col("kind") == 3) | (F.col("one") & (F.col("kind") == 1)), 0).otherwise(F.col("kind")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "place"), F.col("blocks")[F.col("kind")]).cast("int"))
    dealt = dealt.withColumn("part", F.when(F.col("kind") == 2, F.xxhash64("doc_id", "place")).otherwise(F.col("kind").cast("long")))
    dealt = join_spread(scratch.save(dealt.drop("one"), "dealt"), tokens, "doc_id", "key", scratch, "dealt")
    first = F.greatest(F.shiftright("place", 23) - WINDOW, F.lit(0)).cast("int")
    last = F.shiftright("place", 23) + F.shiftright("place", 8).bitwiseAND(0x7FFF)
    dealt = dealt.withColumn("begin", first).withColumn("tokens", F.substring("tokens", F.col("begin") * 4 + 1, ((last + WINDOW + 1 - F.col("begin")) * 4).cast("int")))
    dealt = scratch.save(dealt, "blocks")
    # a block meets itself and those behind it, of its own kind if that is 2, and of further kinds
    partners = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), f))
    numbers = lambda n: F.slice(F.sequence(F.lit(0), n), 1, n)
    tile = lambda k1, b1, k2, b2: F.struct(k1.cast("int").alias("k1"), b1.alias("b1"), k2.cast("int").alias("k2"), b2.alias("b2"))
    k, b = F.col("kind"), F.col("block")
    as_first = partners(lambda o: F.transform(F.filter(numbers(F.col("blocks")[o]), lambda x: (o > k) | ((o == k) & (k == 2) & (x >= b))), lambda x: tile(k, b, o, x)))
    as_second = partners(lambda o: F.transform(F.filter(numbers(F.col("blocks")[o]), lambda x: (o < k) | ((o == k) & (k == 2) & (x <= b))), lambda x: tile(o, x, k, b)))
    columns, by = ["doc_id", "place", "part", "begin", "tokens"], ["key", "k1", "b1", "k2", "b2"]
    # most tiles are small, so that several are dealt to one call
    bunches = -(-(dealt.agg(F.sum(F.size(as_first) + F.size(as_second))).first()[0] or 1) // BUNCH)
    meet = [dealt.withColumn("tile", F.explode(x)).select("key", "tile.*", *columns).groupBy(F.pmod(F.xxhash64(*by), F.lit(bunches))) for x in (as_first, as_second)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = (left if left.num_rows else right).schema.field("doc_id").type
        rows = _join_tiles(left, right) if left.num_rows and right.num_rows else []
        columns, names = _columns(rows or [(None,) * 7], doc)
        return pa.table(columns, names).slice(0, len(rows))

    schema = f"doc_id {kind}, start_word long, end_word long, other_id {kind}, other_start long, other_end long, similarity double"
    out = scratch.save(meet[0].cogroup(meet[1]).applyInArrow(run, schema), "joined")
    scratch.drop("bits", "unjoined", "within", "sizes", "dealt", "blocks")
    return out


def _exact_rest(runs: DataFrame, tokens: DataFrame, passages: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages of windows that another document has word for word and no passage covers yet."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    of_runs = runs.groupBy("doc_id").agg(F.collect_list("place").alias("runs"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("place").bitwiseAND(3).cast("int"))).alias("pairs")).where(F.col("pairs") == 2 ** (FUNCTIONS // 2) - 1).drop("pairs")
    of_passages = passages.select("doc_id", F.col("start_word").cast("int").alias("s"), F.col("end_word").cast("int").alias("e")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("passages"))
    schema = f"h long, doc_id {kind}, at long"
    held = scratch.save(tokens.join(of_runs, "doc_id").join(of_passages, "doc_id", "left").select("doc_id", "tokens", "runs", "passages"), "held")
    scratch.drop("runs", "tokens")
    left = scratch.save(held.mapInArrow(_exact_batches(True), schema), "open")
    asked = scratch.save(left.select("h").distinct(), "asked")
    places = held.mapInArrow(_exact_batches(False), schema).join(sized(asked), "h").groupBy("h", "doc_id").agg(F.min("at").alias("at"))
    places = scratch.save(places, "places")
    shared = places.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    met = left.join(shared, "h").select("h", "doc_id", "at", F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other_id"))
    met = met.join(places.select("h", F.col("doc_id").alias("other_id"), F.col("at").alias("other_at")), ["h", "other_id"])
    # neighbours whose counterparts overlap are one passage: its tokens are those of the windows, on both sides
    order = Window.partitionBy("doc_id", "other_id").orderBy("at")
    jump = (F.col("at") - F.lag("at").over(order) > 1) | (F.abs(F.col("other_at") - F.lag("other_at").over(order)) > WINDOW)
    steps = met.withColumn("new", F.coalesce(jump, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    ends = steps.groupBy("doc_id", "other_id", "run").agg(F.min("at").alias("i"), F.max("at").alias("j"), F.min("other_at").alias("p"), F.max("other_at").alias("q"))
    return ends.select("doc_id", F.col("i").alias("start_word"), (F.col("j") + PASSAGE_WORDS).alias("end_word"), "other_id", F.col("p").alias("other_start"), (F.col("q") + PASSAGE_WORDS).alias("other_end"), F.lit(1.0).alias("similarity"))


def repeated_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_id, other_start, other_end, similarity: passages that another document has too."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = scratch.save(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
    every = docs.mapInArrow(_window_batches, f"key long, doc_id {kind}, place long")
    keys = every.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    # the join never broadcasts, since keys grow with the documents
    runs = scratch.save(every.join(scratch.save(keys, "keys").hint("merge"), "key"), "runs")
    scratch.drop("keys")
    of_lo, of_hi = (F.min(F.when(F.col("doc_id") == F.col(c), F.col("place"))).alias(f"{c}_place") for c in ("lo", "hi"))
    reps = scratch.save(runs.where("doc_id = lo or doc_id = hi").groupBy("key").agg(of_lo, of_hi), "reps")
    link = lambda a, x, b, y: F.struct(a.alias("a"), b.alias("b"), F.struct("key", x.alias("x"), y.alias("y")).alias("link"))
    own, place, lo, hi, lo_place, hi_place = (F.col(c) for c in ("doc_id", "place", "lo", "hi", "lo_place", "hi_place"))
    to = F.array_compact(F.array(F.when(own != lo, link(lo, lo_place, own, place)), F.when(own != hi, link(own, place, hi, hi_place))))
    links = runs.join(reps.hint("merge"), "key").select(F.explode(to).alias("to")).select("to.*")
    pairs = scratch.save(links.groupBy("a", "b").agg(F.collect_set("link").alias("links")), "pairs")
    needed = scratch.save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")
    tokens = scratch.save(docs.join(sized(needed), "doc_id", "left_semi").mapInArrow(_token_batches, f"doc_id {kind}, tokens binary"), "tokens")
    schema = f"doc_id {kind}, start_word long, end_word long, other_id {kind}, other_start long, other_end long, similarity double"
    both = _with_tokens(_with_tokens(pairs, tokens, "b", "a", "y", scratch), tokens, "a", "b", "x", scratch)
    verified = scratch.save(both.select("a", "b", "links", "from_a", "from_b", "tokens_a", "tokens_b").mapInArrow(_verify_batches, f"{schema}, key long"), "passages")
    scratch.drop("pairs", "needed")
    found, failed = verified.where("key is null").drop("key"), verified.where("key is not null")
    found = found.unionByName(_rest_of_groups(runs, reps, failed, tokens, scratch))
    scratch.drop("reps")
    return found.unionByName(_exact_rest(runs, tokens, found, scratch))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), Scratch(spark, "passages"))
