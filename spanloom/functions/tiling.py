"""Tiles: fixed-width coordinate blocks that turn an interval join into an equality join.

All expressions are built-in ones, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default tile width, and the widths 2**n that the command line accepts.
DEFAULT_BIN = 16384
BIN_POWERS = range(11, 20)


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def first_tile(start: Column, bin_size: int = DEFAULT_BIN) -> Column:
    """Tile of the first base; negative starts belong to tile 0."""
    return div(F.greatest(start.cast("long"), F.lit(0).cast("long")), bin_size)


def last_tile(start: Column, end: Column, bin_size: int = DEFAULT_BIN) -> Column:
    """Tile of the last base, never before :func:`first_tile`, so that points and inverted regions have one tile."""
    return F.greatest(first_tile(start, bin_size), first_tile(end - 1, bin_size))


def explode_tiles(df: DataFrame, bin_size: int = DEFAULT_BIN, start: str = "start", end: str = "end", tile: str = "tile", first: str | None = None) -> DataFrame:
    """A copy of each row for every tile it touches; ``first`` names a column to keep its first tile in.

    Rows with a null start or end touch no tile and are left out.
    """
    s, e = F.col(f"`{start}`"), F.col(f"`{end}`")
    if first:
        df = df.withColumn(first, first_tile(s, bin_size))
    return df.withColumn(tile, F.explode(F.sequence(first_tile(s, bin_size), last_tile(s, e, bin_size))))


def overlaps(q_start: Column, q_end: Column, r_start: Column, r_end: Column) -> Column:
    """Half-open overlap; touching ends don't overlap, a point overlaps what it lies strictly inside of."""
    return (r_start < q_end) & (r_end > q_start)


def overlap_length(q_start: Column, q_end: Column, r_start: Column, r_end: Column) -> Column:
    return F.least(q_end, r_end) - F.greatest(q_start, r_start)
