"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; substrings between leftmost
smaller ones are sorted by inducing, named, and the string of names is sorted in turn; all suffixes are
then induced from those. Inducing goes bucket by bucket, a whole bucket at a time, so its cost is linear
in the text with few Python steps. Only the first ``depth`` symbols are told apart, which lets the sort
of names stop early on texts that repeat themselves.
"""

from __future__ import annotations

import numpy as np


def smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; ``s`` ends with its only 0."""
    n = len(s)
    sign = np.sign(s[1:].astype(np.int32) - s[:-1])
    # Equal neighbours take the type of the next unequal pair.
    at = np.where(sign != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    out[:-1] = sign[at] > 0
    return out


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost smaller suffixes in ``lms``."""
    n, k = len(s), len(bounds) - 1
    sa = np.full(n, -1, dtype=np.int64)
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    sizes = np.bincount(chars, minlength=k)
    ends = bounds[1:]
    for c, group in zip(np.flatnonzero(sizes).tolist(), np.split(lms[order], np.cumsum(sizes[sizes > 0])[:-1]), strict=True):
        sa[ends[c] - len(group) : ends[c]] = group
    head = bounds[:-1].copy()

    def spread(batch: np.ndarray, fill: np.ndarray, step: int, want: bool) -> None:
        pred = batch[batch > 0] - 1
        pred = pred[is_s[pred] == want]
        if not len(pred):
            return
        c = s[pred]
        order = np.argsort(c, kind="stable")
        c, pred = c[order], pred[order]
        edge = np.flatnonzero(np.diff(c)) + 1
        first = np.concatenate([[0], edge])
        count = np.diff(np.concatenate([first, [len(c)]]))
        rank = np.arange(len(c)) - np.repeat(first, count)
        sa[fill[c] + step * rank] = pred
        fill[c[first]] += step * count

    for c in range(k):
        at = int(bounds[c])
        while at < head[c]:  # larger suffixes of this bucket, as they come
            to = int(head[c])
            spread(sa[at:to], head, 1, False)
            at = to
        if sizes[c]:
            spread(sa[ends[c] - sizes[c] : ends[c]], head, 1, False)
    tail = ends - 1
    large_ends = head  # larger suffixes fill bounds[c]:head[c]
    for c in range(k - 1, -1, -1):
        at = int(ends[c]) - 1
        while at > tail[c]:  # smaller suffixes of this bucket, from the right
            to = int(tail[c])
            spread(sa[to + 1 : at + 1][::-1], tail, -1, True)
            at = to
        if large_ends[c] > bounds[c]:
            spread(sa[bounds[c] : large_ends[c]][::-1], tail, -1, True)
    sa[0] = n - 1
    return sa


def words_at(s: np.ndarray) -> np.ndarray:
    """For each place its next 4 symbols (each under 2^16) as one number; zeros follow the end."""
    x = np.concatenate([s.astype(np.uint64), np.zeros(4, dtype=np.uint64)])
    return x[:-4] << np.uint64(48) | x[1:-3] << np.uint64(32) | x[2:-2] << np.uint64(16) | x[3:-1]


def rank_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` of them, by doubling ranks."""
    m = len(names)
    rank, h = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        key = rank * (m + 2)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        done = new[-1] == m - 1
        rank = np.empty(m, dtype=np.int64)
        rank[order] = new
        h *= 2
        if done or h >= m:
            break
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (symbols 1..65535) in order of their first ``depth`` symbols, the empty one left out."""
    s = np.concatenate([text.astype(np.int64), [0]])
    n = len(s)
    if n <= 2:
        return np.arange(n - 1)
    counts = np.bincount(s)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    is_s = smaller(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = induce(s, is_s, lms, bounds)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]  # leftmost smaller substrings in order
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.diff(np.concatenate([lms, [n - 1]])) + 1
    same = np.zeros(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero((length[a] == length[b]) & (a < n - 1) & (b < n - 1))
    packed, at = words_at(s), 0
    while len(alive):
        left = length[a[alive]] - at
        shift = (np.uint64(16) * np.clip(4 - left, 0, 3).astype(np.uint64))
        equal = packed[a[alive] + at] >> shift == packed[b[alive] + at] >> shift
        alive, left = alive[equal], left[equal]
        same[alive[left <= 4] + 1] = True
        alive, at = alive[left > 4], at + 4
    names = np.empty(n, dtype=np.int64)
    names[order] = np.cumsum(~same)
    names = names[lms]
    if len(np.unique(names)) < len(names):
        lms = lms[rank_names(names, -(-depth // 2) + 1)]
    else:
        lms = order
    return induce(s, is_s, lms, bounds)[1:]


def permuted_common_prefixes(text: np.ndarray, at: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at ``at[k]`` and ``other[k]``, up to ``most``; 0 may stand for less than ``most``.

    ``at`` ascends. Where both go on by one the prefix shrinks by one, so each such run of pairs is
    compared once, along its whole length.
    """
    out = np.zeros(len(at), dtype=np.int64)
    if not len(at):
        return out
    # Pairs that differ at either end of the first `most` symbols fall short of it.
    hopeful = (text[at] == text[other]) & (text[at + most - 1] == text[other + most - 1])
    run = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)])
    begin = np.flatnonzero(run)
    size = np.diff(np.concatenate([begin, [len(at)]]))
    use = np.add.reduceat(hopeful.astype(np.int64), begin) > 0
    for k in range(0, len(begin), 4096):
        b, r = begin[k : k + 4096][use[k : k + 4096]], size[k : k + 4096][use[k : k + 4096]]
        if not len(b):
            continue
        span = r + most - 1
        offset = np.cumsum(span) - span
        step = np.arange(int(span.sum())) - np.repeat(offset, span)
        unequal = text[np.repeat(at[b], span) + step] != text[np.repeat(other[b], span) + step]
        place = np.where(unequal, np.arange(len(step)), len(step))
        ends = np.repeat(offset + span, span)  # a run's last symbol bounds its prefixes
        upto = np.minimum(np.minimum.accumulate(place[::-1])[::-1], ends)
        inner = np.repeat(offset, r) + np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
        out[np.repeat(b, r) + np.arange(len(inner)) - np.repeat(np.cumsum(r) - r, r)] = np.minimum(upto[inner] - inner, most)
    return out


def repeated_starts(chunks: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each byte chunk, whether the ``window`` bytes at each start also begin at another start of any chunk."""
    parts = [p for c in chunks for p in (c.astype(np.uint16) + 2, np.ones(1, dtype=np.uint16))]
    text = np.concatenate(parts)
    sizes = np.array([len(c) for c in chunks])
    bases = np.cumsum(sizes + 1) - sizes - 1
    starts = np.zeros(len(text), dtype=bool)
    for base, size in zip(bases.tolist(), sizes.tolist(), strict=True):
        starts[base : base + max(0, size - window + 1)] = True
    order = suffix_array(text, window)
    order = order[starts[order]]
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    prefix = permuted_common_prefixes(text, at, before[at], window)
    hit = np.zeros(len(text), dtype=bool)
    hit[at[prefix >= window]] = True
    hit[before[at[prefix >= window]]] = True
    return [hit[b : b + max(0, n - window + 1)] for b, n in zip(bases.tolist(), sizes.tolist(), strict=True)]
