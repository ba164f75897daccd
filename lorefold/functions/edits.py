"""Pairs of texts within an edit distance, from blocks of texts held as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Columns that the bigrams of a block are counted in.
BUCKETS = 256
#: Longest text that a machine word holds the row of an edit matrix for.
WORD = 64
#: Texts and candidate pairs worked on at once.
ROWS_AT_ONCE, CELLS_AT_ONCE, PAIRS_AT_ONCE = 512, 4_000_000, 32_768


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points from 1 up of texts, filled up with zeros at both ends, and their lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0)) + 2), np.int64)
    at = np.arange(out.shape[1] - 2)[None] < lengths[:, None]
    out[:, 1:-1][at] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return out, lengths


def _pairs_of_letters(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bigram) of all bigrams, those with the ends included."""
    row, at = np.nonzero(np.arange(letters.shape[1] - 1)[None] <= lengths[:, None])
    return row, letters[row, at] << 32 | letters[row, at + 1]


def _distances(masks: np.ndarray, of: np.ndarray, n: int, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edit distances of pairs: patterns of n letters up to WORD, given by their places among ``masks``, and texts of ``sizes`` letters.

    masks: for each pattern the places of each letter, as bits. The bit-parallel
    edit matrix of Myers and Hyyro, a step for each letter of the texts.
    """
    one, last = np.uint64(1), np.uint64(n - 1)
    up, down = np.full(len(of), 2**64 - 1, np.uint64), np.zeros(len(of), np.uint64)
    far = np.full(len(of), n, np.int64)
    for j in range(int(sizes.max(initial=0))):
        same = masks[of, texts[:, j]]
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | ~(h | up), up & h
        step = ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
        far += np.where(j < sizes, step, 0)
        more, less = (more << one) | one, less << one
        up, down = less | ~(v | more), more & v
    return far


def close_pairs(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of filled texts whose edits are at most ``1 - least`` of the longer one's letters.

    An edit changes two bigrams at most, so d edits leave ``longer + 1 - 2 d`` in
    common, ends included; products of their counts, which are no less than what
    is in common, are matrix products. What has as many is measured. Pairs of
    texts beyond WORD letters are given as they are: the caller measures them.
    """
    if not left or not right:
        return
    a, n = _letters(left)
    b, m = _letters(right)
    by_n, by_m = np.argsort(n, kind="stable"), np.argsort(m, kind="stable")
    a, n, b, m = a[by_n], n[by_n], b[by_m], m[by_m]
    (row_a, gram_a), (row_b, gram_b) = _pairs_of_letters(a, n), _pairs_of_letters(b, m)
    _, gram, times = np.unique(np.concatenate([gram_a, gram_b]), return_inverse=True, return_counts=True)
    bucket = np.empty(len(times), np.int64)
    bucket[np.argsort(-times, kind="stable")] = np.arange(len(times)) % BUCKETS  # frequent ones don't meet in one
    counts = lambda row, g, size: np.bincount(row * BUCKETS + bucket[g], minlength=size * BUCKETS).reshape(size, BUCKETS).astype(np.float32)
    count_a, count_b = counts(row_a, gram[: len(gram_a)], len(a)), counts(row_b, gram[len(gram_a) :], len(b)).T
    _, number = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = number[: a.size].reshape(a.shape)[:, 1:-1], np.ascontiguousarray(number[a.size :].reshape(b.shape)[:, 1:-1])
    part = 1 - least
    for size in np.unique(n[n > 0]).tolist():
        first, end = np.searchsorted(n, [size, size + 1])
        # the longer text allows the edits that the lengths differ by
        fits = (m > 0) & (np.abs(m - size) <= part * np.maximum(m, size) + 1e-9)
        if not fits.any():
            continue
        low, high = int(np.argmax(fits)), len(fits) - int(np.argmax(fits[::-1]))
        longer = np.maximum(m[low:high], size)
        most = np.floor(part * longer + 1e-9).astype(np.int64)
        needed = (longer + 1 - 2 * most).astype(np.float32) - 0.5
        for r in range(first, end, ROWS_AT_ONCE):
            rows = slice(r, min(end, r + ROWS_AT_ONCE))
            masks = None
            for c in range(low, high, max(1, CELLS_AT_ONCE // ROWS_AT_ONCE)):
                stop = min(high, c + max(1, CELLS_AT_ONCE // ROWS_AT_ONCE))
                of, to = np.divmod(np.flatnonzero(count_a[rows] @ count_b[:, c:stop] > needed[c - low : stop - low]), stop - c)
                if not len(of):
                    continue
                if size > WORD:
                    yield by_n[of + r], by_m[to + c]
                    continue
                if masks is None:
                    masks = np.zeros((rows.stop - r, int(number.max()) + 1), np.uint64)
                    for i in range(size):
                        masks[np.arange(len(masks)), a[rows, i]] |= np.uint64(1 << i)
                for k in range(0, len(of), PAIRS_AT_ONCE):
                    o, t = of[k : k + PAIRS_AT_ONCE], to[k : k + PAIRS_AT_ONCE] + c
                    near = _distances(masks, o, size, b[t], m[t]) <= most[t - low]
                    yield by_n[o[near] + r], by_m[t[near]]
