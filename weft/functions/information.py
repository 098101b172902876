"""Entropies of spectra held as arrays. They differ on purpose; see each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _plogp(values: Column, total: Column) -> Column:
    return -F.aggregate(values, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def spectral_entropy(values: Column, normalise: bool = False) -> Column:
    """In nats; normalised by the log of the number of all entries. 0 without weight."""
    total = _total(values)
    raw = _plogp(values, total)
    if normalise:
        raw = F.when(F.size(values) > 1, raw / F.ln(F.size(values).cast("double"))).otherwise(0.0)
    return F.when(total > 0, raw).otherwise(0.0)


def nonzero_entropy(values: Column, tol: float = 1e-9, normalise: bool = True) -> Column:
    """Of the entries above tol only, normalised by the log of their number."""
    kept = F.filter(values, lambda x: x > tol)
    raw = _plogp(kept, _total(kept))
    return F.when(F.size(kept) == 0, 0.0).when((F.size(kept) > 1) & F.lit(normalise), raw / F.ln(F.size(kept).cast("double"))).otherwise(raw)


def head_entropy(values: Column, k: int, floor: float = 1e-12) -> Column:
    """Of the first k entries in ascending order, with a floor inside the logarithm."""
    head = F.slice(F.array_sort(values), 1, k)
    total = _total(head)
    return F.when(total > 0, -F.aggregate(head, F.lit(0.0), lambda s, x: s + x / total * F.ln(x / total + floor))).otherwise(0.0)


def von_neumann_entropy(values: Column, floor: float = 1e-10) -> Column:
    """Of all eigenvalues clipped at zero; shares below the floor count as the floor."""
    clipped = F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))
    total = _total(clipped)
    share = lambda x: F.greatest(x / total, F.lit(floor))
    return F.when(total < floor, 0.0).otherwise(-F.aggregate(clipped, F.lit(0.0), lambda s, x: s + share(x) * F.ln(share(x))))


def effective_dimension(values: Column, share: float = 0.99) -> Column:
    """Number of largest eigenvalues that make up the share."""
    top = F.reverse(F.array_sort(F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))))
    total = _total(top) + 1e-12
    state = F.aggregate(top, F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when((a["s"] + x) / total < share, 1).otherwise(0)).alias("n")))
    return state["n"]


def relative_entropy(p: Column, q: Column) -> Column:
    """Path relative entropy sum p (ln p - ln q) of two weight arrays after normalisation; entries with p = 0 add nothing."""
    tp, tq = _total(p), _total(q)
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a / tp * (F.ln(a / tp) - F.ln(b / tq))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def hellinger_distance(p: Column, q: Column) -> Column:
    """Between two weight arrays after normalisation."""
    tp, tq = _total(p), _total(q)
    d = F.zip_with(p, q, lambda a, b: (F.sqrt(a / tp) - F.sqrt(b / tq)) * (F.sqrt(a / tp) - F.sqrt(b / tq)))
    return F.sqrt(_total(d) / 2)
