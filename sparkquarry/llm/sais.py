"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of bytes.

Suffixes are classified as larger (L) or smaller (S) than their successor, leftmost smaller (LMS)
substrings are sorted by induction and named, the string of names is sorted recursively, and the
whole array is induced from it in linear time. On bytes a bucket is induced at once with numpy, in
generations (a generation holds what the one before it induced into the same bucket). On names, whose
alphabet is large, a level of the recursion names pairs of the names below it.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last entry is a unique least symbol."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = differs[np.searchsorted(differs, np.arange(len(t) - 1))]  # end of the run of equal symbols
    small = np.empty(len(t), bool)
    small[:-1] = t[at] < t[at + 1]
    small[-1] = True
    return small


def _put(sa: np.ndarray, at: np.ndarray, entries: np.ndarray, symbols: np.ndarray, down: bool) -> None:
    """Appends entries, in order, to their buckets; ``at``: next free place of each bucket."""
    order = np.argsort(symbols, kind="stable")
    symbols, entries = symbols[order], entries[order]
    counts = np.bincount(symbols, minlength=len(at))
    nth = np.arange(len(symbols)) - (np.cumsum(counts) - counts)[symbols]
    if down:
        sa[at[symbols] - nth] = entries
        at -= counts
    else:
        sa[at[symbols] + nth] = entries
        at += counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array induced from LMS positions in this order (within each bucket)."""
    counts = np.bincount(t, minlength=n_symbols)
    heads = np.cumsum(counts) - counts
    tails = heads + counts - 1
    sa = np.full(len(t), -1, np.int64)
    by_symbol = np.argsort(t[lms], kind="stable")
    lms = lms[by_symbol]
    cut = np.searchsorted(t[lms], np.arange(n_symbols + 1))
    free = heads.copy()
    used = np.flatnonzero(counts)
    for c in used:  # larger suffixes, buckets upward
        done = heads[c]
        while done < free[c]:
            j = sa[done : free[c]] - 1
            done = free[c]
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                _put(sa, free, j, t[j], False)
        j = lms[cut[c] : cut[c + 1]] - 1
        j = j[j >= 0]
        if len(j):
            _put(sa, free, j, t[j], False)
    larger_end = free
    free = tails.copy()
    for c in used[::-1]:  # smaller suffixes, buckets downward
        done = tails[c]
        while done > free[c]:
            j = sa[free[c] + 1 : done + 1][::-1] - 1
            done = free[c]
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                _put(sa, free, j, t[j], True)
        j = sa[heads[c] : larger_end[c]][::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            _put(sa, free, j, t[j], True)
    sa[0] = len(t) - 1  # nothing induces the least suffix
    return sa


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal ones; and how many there are."""
    ends = np.append(lms[1:], lms[-1])
    length = np.zeros(len(t), np.int64)
    length[lms] = ends - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        equal = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[length[a[open_]] > k]
    name = np.empty(len(t), np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    return name[lms], int(len(ordered) - same.sum())


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names that ends in a unique 0.

    Level by level pairs of names get a name, so that one stands for twice as many names as before; only
    what still shares its name with another is named again. It ends when all names differ.
    """
    n = len(names)
    sa = np.argsort(names, kind="stable")
    value, reach = names[sa], 1
    head = np.append(True, value[1:] != value[:-1])
    first = np.flatnonzero(head)  # where each group of equal names begins in ``sa``
    rank = np.empty(n, np.int64)
    rank[sa] = first[np.cumsum(head) - 1]
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of ``sa`` in groups of two and more
    while len(open_):
        own = sa[open_]
        group = rank[own]
        # a suffix that shares ``reach`` names with another can't hold the unique last one in them
        key = group * n + rank[own + reach]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[open_] = own  # the groups keep their places, as ``key`` begins with them
        head = np.append(True, key[1:] != key[:-1])
        rank[own] = open_[head][np.cumsum(head) - 1]
        open_ = open_[~(head & np.append(head[1:], True))]
        reach *= 2
    return sa


def suffix_array(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix array of ``t`` (symbols below ``n_symbols``; the last is a unique 0)."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, n_symbols)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    names, k = _named(t, lms, sa[is_lms[sa]])
    if k == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = lms
    else:
        order = lms[_sorted_names(names)]
    return _induce(t, small, order, n_symbols)


def permuted_common_prefixes(data: np.ndarray, left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the prefix shared with the suffix before it in ``sa``, within one string.

    ``left``: bytes left in the string of each position (0 on separators). Only where the bytes
    before both suffixes differ a comparison is made; elsewhere the value is one less than that of
    the position before.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.empty(n, bool)
    own[0] = True
    own[1:] = (before[1:] <= 0) | (left[:-1] == 0) | (left[np.maximum(before[1:] - 1, 0)] == 0) | (data[:-1] != data[np.maximum(before[1:] - 1, 0)])
    at = np.flatnonzero(own)
    most = np.where(before[at] >= 0, np.minimum(left[at], left[before[at]]), 0)
    words = words_at(np.append(data, np.zeros(8, np.uint8)))
    found = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        x = words[at[open_] + found[open_]] ^ words[before[at[open_]] + found[open_]]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        found[open_] += same
        open_ = open_[(same == 8) & (found[open_] < most[open_])]
    values = np.zeros(n, np.int64)
    np.minimum(found, most, out=found)
    nearest = np.cumsum(own) - 1
    values = np.maximum(found[nearest] - (np.arange(n) - at[nearest]), 0)
    return np.minimum(values, left)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; for all but the last seven positions."""
    n = len(data) - 7
    out = np.empty(max(n, 0), "<u8")
    for s in range(min(8, n)):
        part = data[s : s + (n - s + 7) // 8 * 8]
        out[s::8] = part.view("<u8") if part.flags["C_CONTIGUOUS"] else np.ascontiguousarray(part).view("<u8")
    return out
