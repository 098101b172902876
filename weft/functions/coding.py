"""Quantisers, storage arithmetic, grades and triage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantise_unsigned(x: Column, size: int, low: float, high: float) -> Column:
    """Codes 0 to 2^(8 size) - 1 over [low, high], half to even; unknown values are 0."""
    top = (1 << (8 * size)) - 1
    return F.when(_finite(x), F.bround((_clip(x, low, high) - low) / (high - low) * top)).otherwise(0.0).cast("long")


def dequantise_unsigned(code: Column, size: int, low: float, high: float) -> Column:
    top = (1 << (8 * size)) - 1
    return low + _clip(code, 0, top) / top * (high - low)


def quantise_signed(x: Column, size: int, low: float, high: float) -> Column:
    """Symmetric codes around the middle of [low, high]."""
    half, mid, span = (1 << (8 * size - 1)) - 1, (low + high) / 2, (high - low) / 2
    return F.when(_finite(x), F.bround((_clip(x, low, high) - mid) / span * half)).otherwise(0.0).cast("long")


def dequantise_signed(code: Column, size: int, low: float, high: float) -> Column:
    half = (1 << (8 * size - 1)) - 1
    return (low + high) / 2 + _clip(code, -half, half) / half * (high - low) / 2


def quantise_count(x: Column, size: int, cap: int) -> Column:
    return F.when(_finite(x) & (x >= 0), F.least(F.bround(x), F.lit(float(min(cap, (1 << (8 * size)) - 1))))).otherwise(0.0).cast("long")


def log_code(x: Column, size: int, low: float, high: float) -> Column:
    """Unsigned code of the logarithm, for positive values over decades."""
    import math

    return quantise_unsigned(F.ln(F.greatest(x, F.lit(low))), size, math.log(low), math.log(high))


def mesh_bytes(vertices: Column, faces: Column) -> Column:
    """Raw mesh: 24 bytes a vertex, 12 a face."""
    return 24 * vertices + 12 * faces


def coded_bytes(vertices: Column, faces: Column, modes: Column, with_basis: bool = False) -> Column:
    """Spectral code: 32 bytes a mode and the faces; with the basis also 8 bytes a vertex and mode."""
    size = 32 * modes + 12 * faces
    return size + 8 * vertices * modes if with_basis else size


def compression_ratio(vertices: Column, faces: Column, modes: Column, with_basis: bool = False) -> Column:
    return mesh_bytes(vertices, faces) / coded_bytes(vertices, faces, modes, with_basis)


def bits_per_vertex(vertices: Column, faces: Column, modes: Column) -> Column:
    return 8 * coded_bytes(vertices, faces, modes) / vertices


def grade(loss: Column) -> Column:
    return F.when(loss < 0.05, "Excellent").when(loss < 0.15, "Good").when(loss < 0.35, "Fair").otherwise("Poor")


def detail_level(deficit: Column, modes: Column, betti: Column, patch: float, medium: float, low: float) -> Column:
    """Deficit thresholds come first, so a large deficit hides a broken topology; then the mode-count guard."""
    return F.when(deficit > patch, "patch_request").when(deficit > medium, "high").when(deficit > low, "medium").when(modes < betti, "skeleton_only").otherwise("low")


def ucb(mean: Column, std: Column, beta: Column | float) -> Column:
    return mean + F.sqrt(F.lit(beta) if not isinstance(beta, Column) else beta) * std


def beta_schedule(t: Column, arms: int, delta: float = 0.1) -> Column:
    import math

    return 2 * F.ln(arms * t * t * (math.pi**2 / (6 * delta)))


def prompt_of(labels: Column) -> Column:
    """Labels as one prompt: 'a. b. c.'; null and blank labels are left out."""
    kept = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ". "), F.lit("."))).otherwise("")


def labels_of(prompt: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(prompt, F.lit("")), r"\."), lambda x: F.trim(x)), lambda x: x != "")


def quaternion_of(r: Column) -> Column:
    """Unit quaternion x, y, z, w (w not negative) of a rotation matrix given as nine numbers, row by row.

    The part that is surely large is found first; the others follow from sums and differences across the diagonal.
    """
    m = lambda i, j: r[3 * i + j]
    four = {"x": 1 + m(0, 0) - m(1, 1) - m(2, 2), "y": 1 - m(0, 0) + m(1, 1) - m(2, 2), "z": 1 - m(0, 0) - m(1, 1) + m(2, 2), "w": 1 + m(0, 0) + m(1, 1) + m(2, 2)}
    across = {"xw": m(2, 1) - m(1, 2), "yw": m(0, 2) - m(2, 0), "zw": m(1, 0) - m(0, 1), "xy": m(0, 1) + m(1, 0), "xz": m(0, 2) + m(2, 0), "yz": m(1, 2) + m(2, 1)}
    top = F.greatest(*four.values())
    out = None
    for k in "wxyz":
        parts = [four[k] if c == k else across["".join(sorted(c + k, key="xyzw".index))] for c in "xyzw"]
        size = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] + parts[3] * parts[3])
        sign = F.when(parts[3] < 0, -1.0).otherwise(1.0)
        made = F.array(*(p / size * sign for p in parts))
        out = F.when(four[k] == top, made) if out is None else out.when(four[k] == top, made)
    return out


def rotation_of(q: Column) -> Column:
    """Nine numbers, row by row, of a quaternion x, y, z, w; one of no length is no turn."""
    size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (F.when(size > 1e-12, q[k] / size).otherwise(1.0 if k == 3 else 0.0) for k in range(4))
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def quantise_quaternion(q: Column) -> Column:
    """Components as whole numbers of 1 / 32767."""
    return F.transform(q, lambda x: F.bround(_clip(x, -1.0, 1.0) * 32767).cast("int"))


def quantise_translation(t: Column, step: float = 1e-3) -> Column:
    """Components as 32-bit whole numbers of a step."""
    return F.transform(t, lambda x: F.bround(_clip(x / step, -(2**31) + 1, 2**31 - 1)).cast("int"))


def spectrum_bytes(code: Column, top: Column) -> Column:
    """Coefficients as one byte each, 128 in the middle, in steps of top / 127, in hex."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex((F.bround(_clip(c / F.when(top > 0, top).otherwise(1.0), -1.0, 1.0) * 127) + 128).cast("int"))), 2, "0")), "")


def bytes_spectrum(text: Column, top: Column) -> Column:
    """The coefficients back."""
    at = F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1)
    return F.when(F.length(text) > 0, F.transform(at, lambda i: (F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 127 * top)).otherwise(F.array().cast("array<double>"))
