"""Vectors of whole numbers: integers of components, exact inner products, packing for Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to here are exact as doubles, and in sums of 64-bit numbers up to there.
EXACT_DOUBLE, EXACT_LONG = 2.0**52, 2.0**62


def whole(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double; null unless all are finite, also times the scale."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # doubles from 2^52 on are whole numbers
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT_DOUBLE, F.floor(x).cast("double")).otherwise(x))
    return F.when(finite, floors)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows of doubles, filled up with zeros."""
    out = np.zeros((len(column), dim))
    counts = np.diff(column.offsets.to_numpy())
    at = np.repeat(np.arange(len(column)), counts)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def narrow(vectors: np.ndarray) -> tuple[bytes, int]:
    """Bytes of the vectors in the fewest bytes a component that hold them, and how many those are."""
    for kind in (np.int16, np.int32):
        info = np.iinfo(kind)
        if not vectors.size or (vectors.min() >= info.min and vectors.max() <= info.max):
            return vectors.astype(kind).tobytes(), info.bits // 8
    return vectors.tobytes(), 8


def widened(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.float64}[width]).reshape(-1, dim).astype(np.float64)


def largest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max(initial=0))


def exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of left[i] and right[j] as 64-bit numbers, or as whole numbers of any size where these may not do."""
    most = largest(left) * largest(right) * max(1, left.shape[1])
    if most < EXACT_DOUBLE and len(i) * 16 > len(left) * len(right):
        # many are asked for: all products at once are exact, too
        return np.rint((left @ right.T)[i, j]).astype(np.int64)
    parts = [np.zeros(0, np.int64)]
    if most < EXACT_LONG:
        left, right = left.astype(np.int64), right.astype(np.int64)
    else:
        integers = np.frompyfunc(int, 1, 1)
        left, right = integers(left), integers(right)
    for at in range(0, len(i), 65_536):
        a, b = left[i[at : at + 65_536]], right[j[at : at + 65_536]]
        parts.append(np.einsum("ij,ij->i", a, b) if most < EXACT_LONG else (a * b).sum(axis=1))
    return np.concatenate(parts)


def in_64_bits(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as 64-bit numbers, and -1, 0 or 1 for those below, within and above them."""
    if scores.dtype != object:
        return scores.astype(np.int64), np.zeros(len(scores), np.int32)
    over = np.array([(x >= 1 << 63) - (x < -(1 << 63)) for x in scores], np.int32)
    return np.array([0 if o else int(x) for x, o in zip(scores, over, strict=True)], np.int64), over


def order_of(scores: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the scores' order."""
    if scores.dtype != object:
        return scores
    # numbers beyond 64 bits are put in order by their place among all
    return np.searchsorted(np.array(sorted(set(scores.tolist())), object), scores)


def as_doubles(scores: np.ndarray) -> np.ndarray:
    """The scores as doubles; what is beyond these ends at 1e300."""
    if scores.dtype != object:
        return scores.astype(np.float64)
    return np.array([float(max(-(10**300), min(10**300, x))) for x in scores], np.float64)
