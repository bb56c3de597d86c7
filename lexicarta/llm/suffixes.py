"""Suffix arrays by induced sorting, and permuted common prefixes, on whole arrays.

Induced sorting visits suffixes bucket by bucket, where a bucket is all suffixes with the
same first symbol, and puts the suffix one to the left of each into its bucket. How many
suffixes a bucket gets is known from the symbols, so a bucket that has them all can be
visited at once, and so can a stretch of such buckets. A bucket that lacks some gets
them from itself: they start with a run of its symbol, and follow from the lengths of the runs.
"""

from __future__ import annotations

import numpy as np

#: Buckets looked at ahead for a stretch that is complete.
AHEAD = 4096
#: Names up to which the recursion ends, and suffixes are sorted by ranks of twice the length each time.
FEW = 1 << 17


def _run_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every run of equal symbols."""
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    return np.concatenate([[0], last[:-1] + 1]), last


def classified(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one, the sentinel, is."""
    first, last = _run_bounds(text)
    rises = np.append(text[last[:-1]] < text[last[:-1] + 1], True)
    return np.repeat(rises, last - first + 1)


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of smaller suffixes that follow a larger one."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _swept(keys: np.ndarray, n_keys: int, known: np.ndarray, wanted: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """Suffixes of ``wanted`` positions in the order of a sweep over the buckets ``0, 1, ...`` of ``keys``.

    ``known`` are the positions that start the sweep, in their order. In a bucket the wanted
    ones are visited before the known ones.
    """
    sizes = np.bincount(keys[wanted], minlength=n_keys)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    known_begin = np.concatenate([[0], np.cumsum(np.bincount(keys[known], minlength=n_keys))])
    filled = begin[:-1].copy()
    found = np.empty(begin[-1], dtype=known.dtype)
    bucket = 0
    while bucket < n_keys:
        if filled[bucket] < begin[bucket + 1]:
            # What the bucket lacks starts further left in the runs of the positions it has.
            ends = found[begin[bucket] : filled[bucket]]
            lengths = ends - run_start[ends] + 1
            step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.argsort(step, kind="stable")
            found[begin[bucket] : begin[bucket + 1]] = (np.repeat(ends, lengths) - step)[order]
            filled[bucket] = begin[bucket + 1]
        ahead = min(n_keys, bucket + AHEAD)
        lacking = np.flatnonzero(filled[bucket + 1 : ahead] < begin[bucket + 2 : ahead + 1])
        stop = bucket + 1 + int(lacking[0]) if len(lacking) else ahead
        visited = np.concatenate([found[begin[bucket] : begin[stop]], known[known_begin[bucket] : known_begin[stop]]])
        if stop - bucket > 1:
            visited = visited[np.argsort(keys[visited], kind="stable")]
        visited = visited[visited > 0]
        left = visited - 1
        induced = wanted[left] & (keys[left] != keys[visited])
        left = left[induced]
        if len(left):
            to = keys[left]
            order = np.argsort(to, kind="stable")
            to, left = to[order], left[order]
            first, last = _run_bounds(to)
            count = last - first + 1
            found[np.repeat(filled[to[first]] - first, count) + np.arange(len(to))] = left
            filled[to[first]] += count
        bucket = stop
    return found


def induced(text: np.ndarray, n_symbols: int, smaller: np.ndarray, run_start: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the order of the leftmost smaller ones (``seeds``)."""
    larger = _swept(text, n_symbols, seeds, ~smaller, run_start)
    # Backwards, smaller suffixes come from what is already in order. The sentinel is first of all.
    own = smaller.copy()
    own[-1] = False
    backward = (n_symbols - 1 - text).astype(text.dtype)
    rest = _swept(backward, n_symbols, larger[::-1].copy(), own, run_start)[::-1]
    both = np.concatenate([larger, rest])
    # In a bucket larger suffixes, those followed by a smaller symbol, come first.
    order = np.argsort(text[both], kind="stable")
    return np.concatenate([[len(text) - 1], both[order]]).astype(seeds.dtype)


def _named(text: np.ndarray, spots: np.ndarray, in_order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings from each of ``spots`` to the next, equal for equal ones, and their number."""
    stop = np.empty(len(text), dtype=spots.dtype)
    stop[spots] = np.append(spots[1:], len(text) - 1)
    left, right = in_order[:-1], in_order[1:]
    same = (stop[left] - left) == (stop[right] - right)
    same &= (left != len(text) - 1) & (right != len(text) - 1)
    active = np.flatnonzero(same)
    a, b = left[active], right[active]
    span = (stop[left] - left)[active]
    at = 0
    while len(active):
        equal = text[a + at] == text[b + at]
        same[active[~equal]] = False
        go = equal & (span > at)
        active, a, b, span = active[go], a[go], b[go], span[go]
        at += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(text), dtype=spots.dtype)
    names[in_order] = rank
    return names[spots], int(rank[-1]) + 1


def doubled(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of a short text in order, by pairs of ranks."""
    rank = text.astype(np.int64)
    reach = 1
    while True:
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[:-reach] = rank[reach:] + 1
        pair = rank * (len(rank) + 2) + behind
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        ranked = np.append(0, np.cumsum(pair[1:] != pair[:-1]))
        rank[order] = ranked
        if ranked[-1] == len(rank) - 1:
            return order.astype(np.int32)
        reach *= 2


def suffix_array(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Positions of all suffixes in order. The last symbol is 0 and occurs nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    text = text.astype(np.uint16 if n_symbols <= 1 << 16 else np.int32, copy=False)
    smaller = classified(text)
    first, last = _run_bounds(text)
    run_start = np.repeat(first, last - first + 1).astype(np.int32)
    spots = leftmost_smaller(smaller).astype(np.int32)
    seeds = spots[np.argsort(text[spots], kind="stable")]
    first_pass = induced(text, n_symbols, smaller, run_start, seeds)
    marked = np.zeros(n, dtype=bool)
    marked[spots] = True
    in_order = first_pass[marked[first_pass]]
    names, n_names = _named(text, spots, in_order)
    if n_names < len(spots):
        in_order = spots[doubled(names) if len(names) <= FEW else suffix_array(names, n_names)]
    return induced(text, n_symbols, smaller, run_start, in_order)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the length it has in common with the suffix before it in order.

    If the symbols to the left of both are equal, the length is one less than that of
    the position to the left. Only the others are compared, eight bytes at a time; ``text`` is bytes.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[array[0]] = -1
    before[array[1:]] = array[:-1]
    here = np.arange(n)
    own = (before < 1) | (here == 0)
    rest = np.flatnonzero(~own)
    own[rest] = text[rest - 1] != text[before[rest] - 1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.data, strides=(1,))
    spots = np.flatnonzero(own)
    lengths = np.zeros(len(spots), dtype=np.int64)
    active = np.flatnonzero(before[spots] >= 0)
    a, b = spots[active], before[spots[active]]
    at = 0
    while len(active):
        # The sentinel is unique, so no comparison passes the end of the later suffix.
        apart = words[a + at] ^ words[b + at]
        ends = apart != 0
        low = apart[ends] & (~apart[ends] + np.uint64(1))
        lengths[active[ends]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        active, a, b = active[~ends], a[~ends], b[~ends]
        at += 8
    last_own = np.cumsum(own) - 1
    return lengths[last_own] - (here - spots[last_own])
