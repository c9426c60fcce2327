"""Suffix arrays by induced sorting, on arrays of small numbers."""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is the smallest."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run of equal values
    runs = np.diff(np.concatenate(([-1], ends)))
    small = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(small, runs)


def _deal(parts, values, places):
    """Append ``places`` to the lists of their values, keeping their order."""
    order = np.argsort(values, kind="stable")
    values, places = values[order], places[order]
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        parts[values[start]].append(places[start:end])


def _induce(text, small, marked) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs; whole buckets at a time.

    The suffixes before those of a bucket are dealt to the buckets of their first value, first the larger
    ones from the left, then the smaller ones from the right. Those that fall into the bucket being read
    are read next.
    """
    n, top = len(text), int(text.max()) + 1
    starts = [[] for _ in range(top)]
    if len(marked):
        _deal(starts, text[marked], marked)
    larger = [[] for _ in range(top)]
    larger[text[n - 1]].append(np.array([n - 1]))  # before the empty suffix
    if not small[n - 1] and n == 1:
        return np.array([0])

    def step(wave, want, lists, value):
        before = wave[wave > 0] - 1
        before = before[small[before] == want]
        same = text[before] == value
        away = before[~same]
        if len(away):
            _deal(lists, text[away], away)
        return before[same]

    def read(lists, value, want):
        """Read a bucket, with what falls into it meanwhile, and leave it as one array."""
        waves = [np.concatenate(lists[value])] if lists[value] else []
        while waves and len(rest := step(waves[-1], want, lists, value)):
            waves.append(rest)
        lists[value] = np.concatenate(waves) if waves else np.zeros(0, np.int64)

    for value in range(top):
        read(larger, value, False)
        if starts[value]:
            step(np.concatenate(starts[value]), False, larger, value)
    smaller = [[] for _ in range(top)]
    for value in range(top - 1, -1, -1):
        read(smaller, value, True)
        step(larger[value][::-1], True, smaller, value)
    out = []
    for value in range(top):
        out += [larger[value], smaller[value][::-1]]
    return np.concatenate(out)


def _names(text, small, order, marked) -> np.ndarray:
    """Names of the leftmost-smaller substrings by their order in ``order``; equal ones share a name."""
    n = len(text)
    end = np.append(marked[1:], n)
    place = np.full(n, -1)
    place[marked] = np.arange(len(marked))
    sorted_marked = place[order]
    sorted_marked = sorted_marked[sorted_marked >= 0]
    a, b = sorted_marked[:-1], sorted_marked[1:]
    length = end - marked
    # up to and with the first position of the next one, as many values at a time as 64 bits hold
    width = 4 if int(text.max()) < 1 << 15 else 1
    both = np.concatenate([text.astype(np.uint64) * np.uint64(2) + small, np.zeros(width - 1, np.uint64)])
    words = both[:n].copy()
    for k in range(1, width):
        words |= both[k : k + n] << np.uint64(16 * k)
    masks = np.array([(1 << 16 * k) - 1 for k in range(width)] + [(1 << 64) - 1], np.uint64)
    same = (length[a] == length[b]) & (end[a] < n) & (end[b] < n)
    live, off = np.flatnonzero(same), 0
    x, y, left = marked[a[live]], marked[b[live]], length[a[live]] + 1
    while len(live):
        other = ((words[x + off] ^ words[y + off]) & masks[np.minimum(left - off, width)]) != 0
        same[live[other]] = False
        on = ~other & (left > off + width)
        live, x, y, left = live[on], x[on], y[on], left[on]
        off += width
    names = np.empty(len(marked), np.int64)
    names[sorted_marked] = np.concatenate(([0], np.cumsum(~same)))
    return names


def _doubling(names: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet, by doubling; only the suffixes that are
    still alike are sorted again. Those alike in ``depth`` values may stay in any order."""
    n = len(names)

    def by(key, top):
        """``key`` (below ``top``) in order, and where each came from."""
        bits = max(1, (len(key) - 1).bit_length())
        if top << bits < 1 << 63:
            packed = np.sort((key << bits) | np.arange(len(key)))
            return packed >> bits, packed & ((1 << bits) - 1)
        order = np.argsort(key, kind="stable")
        return key[order], order

    rank, tied, h = np.zeros(n, np.int64), None, 1
    key, top = names.astype(np.int64), int(names.max()) + 1
    while True:
        key, order = by(key, top)
        places = np.arange(len(key))
        fresh = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(fresh, places, 0))
        if tied is None:
            moved = order
            rank[moved] = first + 1  # 0 is behind the end
        else:
            moved = tied[order]
            old = rank[moved]
            head = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), places, 0))
            rank[moved] = old + first - head
        tied = moved[~(fresh & np.append(fresh[1:], True))]
        if not len(tied):
            out = np.empty(n, np.int64)
            out[rank - 1] = np.arange(n)
            return out
        if h >= (n if depth is None else min(depth, n)):
            return np.argsort(rank, kind="stable")
        after = tied + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        key, top, h = rank[tied] * (n + 1) + second, (n + 1) ** 2, 2 * h


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``text`` (values from 0) in order. The string of names is sorted in turn: again by
    induction while its alphabet is small, else by doubling. Suffixes alike in ``depth`` values may stand
    in any order."""
    n = len(text)
    if n < 3 or len(text) < 32:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    if text.dtype != np.uint16 and int(text.max()) < 1 << 16:
        text = text.astype(np.uint16)  # numpy sorts these by digits
    small = _types(text)
    marked = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(marked):
        return _induce(text, small, marked)
    names = _names(text, small, _induce(text, small, marked), marked)
    kinds = int(names.max()) + 1
    if kinds == len(marked):
        order = np.argsort(names)
    elif kinds <= 512:
        order = suffix_array(names, depth)
    else:
        order = _doubling(names, depth)
    return _induce(text, small, marked[order])


def permuted_prefix_at_least(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By text position: does the suffix share ``length`` bytes with the one before it in ``order``?

    Eight bytes are compared at a time, in the order of the text; ``data`` are bytes, and suffixes shorter
    than ``length`` share nothing.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    live = np.flatnonzero((before >= 0) & (np.arange(n) + length <= n))
    live = live[before[live] + length <= n]
    for off in [*range(0, length - 7, 8), length - 8]:
        live = live[words[live + off] == words[before[live] + off]]
    out = np.zeros(n, bool)
    out[live] = True
    return out
