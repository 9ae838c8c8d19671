"""Recursive graph bisection of documents by the terms they share, in numpy on a bounded number of documents.

Documents are split into halves; swaps of pairs lower the sum, over terms and halves, of d * log2(n / (d + 1)) for a
term in d of a half's n documents, which estimates the bits of the gaps in its posting list; then each half is split again.
``order`` gives the documents of one shard their places. ``Tree`` keeps the splits of a sample as weights of terms, so that any
other document finds its leaf: at each node it goes where its terms cost less.
"""

from __future__ import annotations

import numpy as np

from .common import sums


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    return d * np.log2(max(1, n) / (d + 1.0))


def halves(ptr: np.ndarray, terms: np.ndarray, n_terms: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which documents are in the left half, and what a term costs more on the right than on the left."""
    n = len(ptr) - 1
    left = np.arange(n) < n // 2
    doc = np.repeat(np.arange(n), np.diff(ptr))
    total = np.bincount(terms, minlength=n_terms)
    n_left, n_right = n // 2, n - n // 2
    d_left = np.bincount(terms[left[doc]], minlength=n_terms)
    for _ in range(rounds):
        d_right = total - d_left
        now = _cost(d_left, n_left) + _cost(d_right, n_right)
        to_right = now - _cost(np.maximum(d_left - 1, 0), n_left) - _cost(d_right + 1, n_right)
        to_left = now - _cost(d_left + 1, n_left) - _cost(np.maximum(d_right - 1, 0), n_right)
        gain = sums(np.where(left[doc], to_right[terms], to_left[terms]), ptr)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        swapped = int(np.count_nonzero(gain[a[:pairs]] + gain[b[:pairs]] > 1e-9))
        if not swapped:
            break
        left[a[:swapped]], left[b[:swapped]] = False, True
        d_left = np.bincount(terms[left[doc]], minlength=n_terms)
    d_right = total - d_left
    more = _cost(d_right + 1, n_right) - _cost(d_right, n_right) - _cost(d_left + 1, n_left) + _cost(d_left, n_left)
    return left, more


def _taken(ptr: np.ndarray, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``docs`` of a table of terms."""
    n = np.diff(ptr)[docs]
    out = np.append(0, np.cumsum(n))
    at = np.repeat(ptr[docs] - out[:-1], n) + np.arange(out[-1])
    return out, terms[at]


def order(ptr: np.ndarray, terms: np.ndarray, n_terms: int, least: int = 128, rounds: int = 8) -> np.ndarray:
    """The documents in an order in which those that share terms are near each other; parts of ``least`` are not split."""
    done, open_ = [], [np.arange(len(ptr) - 1)]
    while open_:
        docs = open_.pop()
        if len(docs) <= least:
            done.append(docs)
            continue
        own_ptr, own = _taken(ptr, terms, docs)
        used, own = np.unique(own, return_inverse=True)
        left, _ = halves(own_ptr, own, len(used), rounds)
        open_ += [docs[~left], docs[left]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Tree:
    """Splits of a sample: node i has the children 2i+1 and 2i+2, the lowest level are the leaves."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, n_terms: int, depth: int, rounds: int = 20):
        self.depth = depth
        self.weights = np.zeros((max(1, 2**depth - 1), n_terms), np.float32)
        self.least = np.zeros(len(self.weights))
        open_ = [(0, np.arange(len(ptr) - 1))] if depth else []
        while open_:
            node, docs = open_.pop()
            if len(docs) < 2:
                continue
            own_ptr, own = _taken(ptr, terms, docs)
            left, more = halves(own_ptr, own, n_terms, rounds)
            self.weights[node] = more
            self.least[node] = np.median(sums(self.weights[node][own].astype(np.float64), own_ptr))
            for child, part in ((2 * node + 1, docs[left]), (2 * node + 2, docs[~left])):
                if child < len(self.weights):
                    open_.append((child, part))

    def leaves(self, ptr: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of each document, numbered from 0 in their order."""
        node = np.zeros(len(ptr) - 1, np.int64)
        doc = np.repeat(np.arange(len(node)), np.diff(ptr))
        for _ in range(self.depth):
            left = sums(self.weights[node[doc], terms].astype(np.float64), ptr) > self.least[node]
            node = 2 * node + 2 - left
        return node - (2**self.depth - 1)
