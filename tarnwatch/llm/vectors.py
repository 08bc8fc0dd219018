"""Blocks of integer vectors: what the two vector operators share.

A component x becomes floor(scale * x). Rows travel as *blocks*, rows of a table that carry up to `BLOCK` vectors of one
dimension as binary columns, so that products run as matrix products and no vector is a Python object.

A list of the best rows is ordered by score, highest first, then by vec_id, rows without a vec_id last.
"""

import numpy as np
import pyarrow as pa

BLOCK = 2048  # vectors in a block
CELL = 16_384  # vectors on either side of a cell, the part of the product that one task holds
STRIP = 128  # rows of a product that are selected from at once
EXACT = float(1 << 53)
NAMED, NAMELESS, NOTHING = 0, 1, 2  # kinds of entries in a list: with vec_id, without, no entry


def integer_rows(column: pa.Array, scale: int):
    """(row numbers, lengths, values) of the vectors without NULL or non-finite components; values end to end, as long.

    Values beyond the range of long become its ends.
    """
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    x = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(good)
    lengths = np.diff(offsets)[rows]
    inside = np.repeat(offsets[:-1][rows], lengths) + _steps(lengths)
    with np.errstate(over="ignore"):
        z = np.floor(x[inside] * scale)
    return rows, lengths, np.clip(z, -(2.0**63 - 1024), 2.0**63 - 1024).astype(np.int64)


def _steps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .., for each of the lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def matrices(column: pa.Array, scale: int):
    """For each dimension in the column: (dimension, row numbers, matrix of integers)."""
    rows, lengths, values = integer_rows(column, scale)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), rows[at], values[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)


def names(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 where NULL) and their kinds."""
    kinds = np.where(column.is_valid().to_numpy(zero_copy_only=False), NAMED, NAMELESS).astype(np.int8)
    return column.cast(pa.int64()).fill_null(0).to_numpy(), kinds


def by_name(ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, kinds))


def packed(z: np.ndarray) -> bytes:
    """The matrix as 32-bit numbers where these hold it, as 64-bit numbers otherwise; `unpacked` tells by the length."""
    small = not z.size or max(abs(int(z.min())), abs(int(z.max()))) < 1 << 31
    return np.ascontiguousarray(z, np.int32 if small else np.int64).tobytes()


def unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * n * dim else np.int32).reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` and of `b`, exact; beyond 63 bits they wrap as those of long numbers do."""
    largest = [max(float(x.max()), -float(x.min())) if x.size else 0.0 for x in (a, b)]
    if largest[0] * largest[1] * max(a.shape[1], 1) < EXACT:
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def lowest(scores: np.ndarray):
    """A value below all scores of the table, for places that take no part."""
    return -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min


def hide_own(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, kinds: np.ndarray) -> None:
    """Puts out the places of rows that carry the asking row's own id. `ids` are in order within the named kind."""
    named = ids[: int((kinds == NAMED).sum())]
    lo, hi = np.searchsorted(named, own), np.searchsorted(named, own, side="right")
    for i in np.flatnonzero(hi > lo):
        scores[i, lo[i] : hi[i]] = lowest(scores)


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the list, column) of the first k entries of each row; columns are in order of name.

    Partial selection: the k-th highest score of a row is found without sorting; only places at or above it are sorted.
    """
    out = lowest(scores)
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= kth[:, None]) & (scores > out))
    else:
        row, col = np.nonzero(scores > out)
    s = scores[row, col]
    order = np.lexsort((-s if s.dtype.kind == "f" else ~s, row))  # stable: equal scores stay in order of name
    row, col = row[order], col[order]
    counts = np.bincount(row, minlength=len(scores))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = place < k
    return row[keep], place[keep], col[keep]


class Lists:
    """The best k rows of each asking row: scores, kinds and ids, best first."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), np.iinfo(np.int64).min), np.zeros((n, k), np.int64)
        self.kinds = np.full((n, k), NOTHING, np.int8)

    @classmethod
    def of(cls, scores: bytes, kinds: bytes, ids: bytes, k: int) -> "Lists":
        out = cls(0, k)
        out.scores, out.ids, out.kinds = (np.frombuffer(x, t).reshape(-1, k) for x, t in ((scores, np.int64), (ids, np.int64), (kinds, np.int8)))
        return out

    def merged(self, other: "Lists", at: slice = slice(None)) -> None:
        """Takes another list of the rows `at` in."""
        k = self.scores.shape[1]
        s, d, i = (np.concatenate((getattr(self, x)[at], getattr(other, x)), axis=1) for x in ("scores", "kinds", "ids"))
        order = np.lexsort((i, d, ~s, d == NOTHING), axis=1)[:, :k]
        for name, x in (("scores", s), ("kinds", d), ("ids", i)):
            held = getattr(self, name)
            if not held.flags.writeable:
                held = held.copy()
                setattr(self, name, held)
            held[at] = np.take_along_axis(x, order, axis=1)
