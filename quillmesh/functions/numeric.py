"""Scores and vector expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_fixed(x: Column, digits: int) -> Column:
    """x rounded half away from zero on the double as it is; no negative zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1 and 1; 0 for missing, empty, unequally long or zero vectors."""
    norms = dot(a, a) * dot(b, b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(fits, clamp(dot(a, b) / F.sqrt(norms), -1.0, 1.0)), F.lit(0.0))


def _pair_cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """cosine() of many pairs at once; null where either vector is."""
    both = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    size = [x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b)]
    out = np.zeros(len(a))
    for dim in np.unique(size[0][both & (size[0] == size[1]) & (size[0] > 0)]):
        at = np.flatnonzero(both & (size[0] == dim) & (size[1] == dim))
        x, y = (v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for v in (a, b))
        norms = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
        out[at] = np.where(norms > 0, np.clip(np.einsum("ij,ij->i", x, y) / np.sqrt(np.where(norms > 0, norms, 1)), -1, 1), 0)
    return pa.array(out, mask=~both)


#: Marked so that the optimiser never repeats it in the expressions that use its result.
pair_cosine = F.arrow_udf(_pair_cosine, T.DoubleType()).asNondeterministic()


def normalize_similarity(raw: Column, floor: float = 0.70, ceiling: float = 0.95) -> Column:
    """A cosine stretched from [floor, ceiling] to [0, 1], 4 places; as it is where the range is empty."""
    finite = raw.isNotNull() & ~F.isnan(raw)
    scaled = raw if ceiling <= floor else (raw - floor) / (ceiling - floor)
    return F.when(finite, to_fixed(clamp(scaled, 0.0, 1.0), 4))


def combine(taxonomy: Column, semantic: Column, wt: float = 0.40, ws: float = 0.60) -> Column:
    """The weighted mean of both scores; the taxonomy's alone where there is no other."""
    both = (taxonomy + semantic) / 2 if wt + ws <= 0 else (taxonomy * wt + semantic * ws) / (wt + ws)
    return to_fixed(F.coalesce(both, taxonomy), 4)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def project_2d(v: Column) -> Column:
    """struct<x, y>: a vector's two fixed trigonometric projections."""
    at = F.sequence(F.lit(1), F.size(v))
    # Factors of the layout: fixed values.
    x = F.aggregate(F.zip_with(v, at, lambda a, i: a * F.sin(i * 12.9898)), F.lit(0.0), lambda s, y: s + y)
    y = F.aggregate(F.zip_with(v, at, lambda a, i: a * F.cos(i * 78.233)), F.lit(0.0), lambda s, z: s + z)
    return F.struct(x.alias("x"), y.alias("y"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # A character beyond 16 bits is a pair of units.
    pair = lambda c: F.array(F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    units = F.flatten(F.transform(points, lambda c: F.when(c > 0xFFFF, pair(c)).otherwise(F.array(c))))
    mask = F.lit(0xFFFFFFFF)
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(mask))
