"""Inner products of vectors of whole numbers, exact whatever their size, and packed tables of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a bigint column can hold.
LEAST, MOST = -(2**63), 2**63 - 1


def all_finite(vector: Column) -> Column:
    """True for a vector that is not null and has no null or non-finite component; an empty one has none."""
    x = vector.cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column as rows of doubles; shorter ones end in zeros, which no inner product sees."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), most))
    out[np.arange(most) < sizes[:, None]] = flat
    return out


def whole(x: float) -> int:
    """floor(256 x), also where 256 x is beyond a double."""
    return math.floor(x * 256) if abs(x) < 2.0**900 else int(x) * 256


class Wholes:
    """floor(256 x) of rows of finite doubles.

    Rows are told apart by size: sums of products of small ones are exact in doubles, of middle ones in 64-bit integers,
    of large ones in Python's integers. So one large row slows no other one down, and none is rounded.
    """

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        spare = math.ceil(math.log2(max(self.dims, 1)))
        sizes = np.abs(x).max(axis=1, initial=0.0)
        self.kinds = (sizes >= 2.0 ** ((53 - spare) // 2 - 9)).astype(int) + (sizes >= 2.0 ** ((62 - spare) // 2 - 9))
        self.rows = [np.nonzero(self.kinds == k)[0] for k in range(3)]
        with np.errstate(over="ignore"):
            self.floors = np.floor(x * 256)
        self.large = np.array([[whole(c) for c in r] for r in x[self.rows[2]].tolist()], dtype=object).reshape(len(self.rows[2]), self.dims)

    def of(self, kind: int, number: int) -> np.ndarray:
        """The rows of one kind in the numbers of this or a larger kind."""
        if kind == 2:
            return self.large
        part = self.floors[self.rows[kind]]
        return part if number == 0 else part.astype(np.int64) if number == 1 else part.astype(np.int64).astype(object)

    def take(self, rows: np.ndarray) -> Wholes:
        out = Wholes.__new__(Wholes)
        out.n, out.dims, out.kinds, out.floors = len(rows), self.dims, self.kinds[rows], self.floors[rows]
        out.rows = [np.nonzero(out.kinds == k)[0] for k in range(3)]
        at = np.searchsorted(self.rows[2], rows[out.rows[2]])
        out.large = self.large[at]
        return out

    def products(self, other: Wholes) -> np.ndarray:
        """Inner products of all rows with all rows of the other one: int64, or Python's integers if a large row is there."""
        dims = min(self.dims, other.dims)
        out = np.zeros((self.n, other.n), dtype=object if len(self.rows[2]) or len(other.rows[2]) else np.int64)
        for i, mine in enumerate(self.rows):
            for j, theirs in enumerate(other.rows):
                if len(mine) and len(theirs) and dims:
                    number = max(i, j)
                    product = self.of(i, number)[:, :dims] @ other.of(j, number)[:, :dims].T
                    out[np.ix_(mine, theirs)] = product.astype(np.int64) if number == 0 else product
        return out


def first_places(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of higher scores first, then smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k])), dtype=np.int64)
    return np.lexsort((ids, -scores))


def written(score: int) -> tuple[int, str]:
    """(bigint, rest): larger pairs are larger scores. The rest is empty but for scores that a bigint cannot hold."""
    if LEAST < score <= MOST:
        return score, ""
    digits = f"{abs(score):x}"
    key = f"{len(digits):06x}{digits}"
    return (MOST, key) if score > 0 else (LEAST, "".join(f"{15 - int(c, 16):x}" for c in key))


def read(score: int, rest: str) -> int:
    """The score that written() gave."""
    if not rest:
        return score
    return int(rest[6:], 16) if score > 0 else -int("".join(f"{15 - int(c, 16):x}" for c in rest)[6:], 16)
