"""Look-up tables held in columns: axis search, interpolation, extrapolation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def segment(axis: Column, x: Column) -> Column:
    """Index of the axis segment used for x; outside values use the end segments."""
    below = F.size(F.filter(axis, lambda a: a <= x)) - 1
    return F.greatest(F.lit(0), F.least(below, F.size(axis) - 2))


def _mix(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def lut1(axis: Column, vals: Column, x: Column) -> Column:
    i = segment(axis, x)
    line = _mix(x, F.get(axis, i), F.get(axis, i + 1), F.get(vals, i), F.get(vals, i + 1))
    return F.when(F.size(axis) <= 1, F.get(vals, F.lit(0))).otherwise(line)


def lut1_clip(axis: Column, vals: Column, x: Column) -> Column:
    """1-D value that is 0 below the axis and the last entry above it."""
    return (F.when(x < F.get(axis, F.lit(0)), 0.0)
            .when(x >= F.element_at(axis, -1), F.element_at(vals, -1))
            .otherwise(lut1(axis, vals, x)))


def _at(vals: Column, ncol: Column, i: Column, j: Column) -> Column:
    return F.get(vals, i * ncol + j)


def lut2(ax1: Column, ax2: Column, vals: Column, x: Column, y: Column) -> Column:
    """Bilinear value of a row-major flattened table; one-entry axes drop out."""
    n2 = F.size(ax2)
    i, j = segment(ax1, x), segment(ax2, y)

    def along2(row: Column) -> Column:
        line = _mix(y, F.get(ax2, j), F.get(ax2, j + 1), _at(vals, n2, row, j), _at(vals, n2, row, j + 1))
        return F.when(n2 <= 1, _at(vals, n2, row, F.lit(0))).otherwise(line)

    line = _mix(x, F.get(ax1, i), F.get(ax1, i + 1), along2(i), along2(i + 1))
    return F.when(F.size(ax1) <= 1, along2(F.lit(0))).otherwise(line)


def lut3(ax1: Column, ax2: Column, ax3: Column, vals: Column, x: Column, y: Column, z: Column) -> Column:
    """Trilinear value; planes of the first axis are plain 2-D tables."""
    plane = F.size(ax2) * F.size(ax3)
    i = segment(ax1, x)

    def at(k: Column) -> Column:
        return lut2(ax2, ax3, F.slice(vals, k * plane + 1, plane), y, z)

    return F.when(F.size(ax1) <= 1, at(F.lit(0))).otherwise(
        _mix(x, F.get(ax1, i), F.get(ax1, i + 1), at(i), at(i + 1)))


def lut2_by_name(var1: Column, ax1: Column, ax2: Column, vals: Column, slew: Column, cap: Column) -> Column:
    """2-D value where the first axis may be the load instead of the slew."""
    swapped = var1.like("%cap%")
    return lut2(ax1, ax2, vals, F.when(swapped, cap).otherwise(slew), F.when(swapped, slew).otherwise(cap))


def add_lut2(df, name: str, ax1: str, ax2: str, vals: str, x: Column, y: Column):
    """Add a bilinear column, finding both segments once in a projection of their own."""
    df = df.withColumns({"_x": x, "_y": y}).withColumns(
        {"_i": segment(F.col(ax1), F.col("_x")), "_j": segment(F.col(ax2), F.col("_y")),
         "_n1": F.size(ax1), "_n2": F.size(ax2)})
    a1, a2, v = F.col(ax1), F.col(ax2), F.col(vals)
    i, j, n1, n2, xx, yy = (F.col(c) for c in ("_i", "_j", "_n1", "_n2", "_x", "_y"))

    def row(k: Column) -> Column:
        line = _mix(yy, F.get(a2, j), F.get(a2, j + 1), _at(v, n2, k, j), _at(v, n2, k, j + 1))
        return F.when(n2 <= 1, _at(v, n2, k, F.lit(0))).otherwise(line)

    out = F.when(n1 <= 1, row(F.lit(0))).otherwise(
        _mix(xx, F.get(a1, i), F.get(a1, i + 1), row(i), row(i + 1)))
    return df.withColumn(name, out).drop("_x", "_y", "_i", "_j", "_n1", "_n2")
