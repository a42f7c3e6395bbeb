"""Parsing of tab-separated region lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A strict line's contig begins so and is shorter than this; an end must lie below this in a list of files.
CONTIG_PREFIX = "chr"
CONTIG_LENGTH = 40
END_LIMIT = 321000000


def lenient_int(text: Column) -> Column:
    """Leading digits with an optional sign, after white space; 0 where there are none. Null stays null."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def parse_bed(line: Column, strict: bool = True) -> Column:
    """Struct(ok, contig, start, end, value, name) of a line.

    ``ok``: at least three fields and, if ``strict``, a contig with the usual prefix and length and an end above 0.
    The value is the fifth field's leading integer, 0 where it is missing.
    """
    fields = F.split(F.rtrim(line, F.lit("\r")), "\t")
    field = lambda i: F.get(fields, F.lit(i))
    contig, end = field(0), lenient_int(field(2))
    ok = F.size(fields) >= 3
    if strict:
        ok = ok & contig.startswith(CONTIG_PREFIX) & (F.length(contig) < CONTIG_LENGTH) & (end > 0)
    value = F.coalesce(lenient_int(field(4)), F.lit(0)).try_cast("int")
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"), contig.alias("contig"), lenient_int(field(1)).alias("start"), end.alias("end"), F.coalesce(value, F.lit(0)).alias("value"), field(3).alias("name")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
