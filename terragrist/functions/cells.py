"""Cell ids as 64-bit numbers in the public hexagonal-grid layout: 4 bits mode at 59, 4 bits resolution at 52, 7 bits
base cell at 45, fifteen digits of 3 bits. All of this is integer arithmetic on Columns and stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RES_MASK = ~(15 << 52)
#: Mean edge length in kilometres by resolution, as published for the grid; fixed values.
EDGE_KM = (1281.256011, 483.0568391, 182.5129565, 68.97922179, 26.07175968, 9.854090990, 3.724532667, 1.406475763, 0.531414010, 0.200786148, 0.075863783, 0.028663897, 0.010830188, 0.004092010, 0.001546100, 0.000584169)
#: Children of a cell one resolution finer.
APERTURE = 7


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(F.lit(127)).cast("int")


def digit(cell: Column, at: int) -> Column:
    """The digit of resolution `at`, 1 to 15; 7 beyond the cell's resolution."""
    return F.shiftright(cell, 3 * (15 - at)).bitwiseAND(F.lit(7)).cast("int")


def parent(cell: Column, res: int) -> Column:
    """The ancestor at a coarser or equal resolution."""
    if not 0 <= res <= 15:
        raise ValueError("resolution must be between 0 and 15")
    return cell.bitwiseAND(F.lit(_RES_MASK)).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit((1 << 3 * (15 - res)) - 1))


def to_string(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def from_string(text: Column) -> Column:
    """Null if the text is no hexadecimal number of at most 15 digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(text, 16, 10).cast("long"))


def parent_of_string(text: Column, res: int) -> Column:
    return to_string(parent(from_string(text), res))


def children_count(res: int, finer: int) -> int:
    """Children of a hexagon (not a pentagon)."""
    return APERTURE ** (finer - res)


def edge_length_m(res: int) -> float:
    return EDGE_KM[res] * 1000


def max_pixel_spacing_m(res: int) -> float:
    """The widest sample spacing that leaves no cell of the resolution without a sample: 0.85 * sqrt(6) / 2 edges."""
    return 0.85 * math.sqrt(6) / 2 * edge_length_m(res)


def pixel_resolution(pixel_m: float, max_subsample: float = 1.0) -> int:
    """The finest resolution whose spacing, times the subsampling, is at least a pixel; 0 if none is."""
    return next((r for r in range(15, -1, -1) if max_pixel_spacing_m(r) * max_subsample >= pixel_m), 0)


def subsample_offsets(n: int) -> list[float]:
    """Centred offsets of n samples across a pixel, in pixels."""
    return [-0.5 + (i + 0.5) / n for i in range(n)]


def coverage_parent_resolution(res: int) -> int | None:
    """The parent resolution of hierarchical coverage: two coarser from 6 on, none below."""
    return None if res < 6 else max(0, res - 2)
