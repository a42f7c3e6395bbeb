"""Column expressions: tiles, overlaps, tolerant number and line parsing."""

from spanloom.functions.parsing import basename, lenient_int, parse_bed
from spanloom.functions.tiling import DEFAULT_BIN, explode_tiles, first_tile, last_tile, overlap_length, overlaps

__all__ = ["DEFAULT_BIN", "basename", "explode_tiles", "first_tile", "last_tile", "lenient_int", "overlap_length", "overlaps", "parse_bed"]
