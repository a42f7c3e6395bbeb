"""Command line: build a store of region files and search it.

    python -m spanloom.cli create IN OUT NAME [-s 0|1|2] [-b N] [-f]
    python -m spanloom.cli search STORE -q FILE | -r CONTIG START END | -m  [-v N] [-s] [-f] [-o FILE]

Of several of -q, -r, -m and -s (similarity) the last one counts, but -s never replaces -r.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tiling import BIN_POWERS, DEFAULT_BIN
from spanloom.operators import overlap
from spanloom.shared import scope
from spanloom.sources import bed, sinks
from spanloom.sources.store import IntervalStore


class _Mode(argparse.Action):
    """Notes the last mode named, beside the flag's own values."""

    def __call__(self, parser, namespace, values, option_string=None):
        mode = {"-q": "queries", "-r": "region", "-m": "matrix", "-s": "similarity"}[option_string]
        if values:
            setattr(namespace, self.dest, values)
        if not (mode == "similarity" and namespace.mode == "region"):
            namespace.mode = mode


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("name")
    c.add_argument("-s", dest="kind", type=int, default=1, choices=(0, 1, 2), help="0: without values, 1: with, 2: one file, datasets named in column 4")
    c.add_argument("-b", dest="power", type=int, default=14, help="tiles of 2**N; out of range is ignored")
    c.add_argument("-f", dest="from_list", action="store_true", help="the input lists files")
    s = sub.add_parser("search")
    s.add_argument("store")
    s.add_argument("-q", dest="queries", action=_Mode)
    s.add_argument("-r", dest="region", nargs=3, action=_Mode)
    s.add_argument("-m", dest="mode", nargs=0, action=_Mode)
    s.add_argument("-v", dest="value", type=int, default=0)
    s.add_argument("-s", dest="mode", nargs=0, action=_Mode)
    s.add_argument("-f", dest="full", action="store_true")
    # Fixed value: the default name of the matrix file.
    s.add_argument("-o", dest="out", default="Hitsmap")
    s.add_argument("-c", dest="column", nargs="?", help="accepted, without effect")
    return p


def bin_size(power: int) -> int:
    return 1 << power if power in BIN_POWERS else DEFAULT_BIN


def create(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """Build the store; its summary is the line that comes back."""
    if a.kind == 0:
        rows, names = bed.read_folder(spark, a.input, with_value=False)
    elif a.kind == 2:
        rows, names = bed.read_named(spark, a.input)
    elif a.from_list:
        rows, names = bed.read_list(spark, a.input)
    else:
        rows, names = bed.read_folder(spark, a.input)
    store = IntervalStore.create(spark, f"{a.output.rstrip('/')}/{a.name}", rows, names, bin_size(a.power))
    total = store.datasets.agg(F.sum("n_regions"), F.sum(F.col("n_regions") * F.coalesce("avg_size", F.lit(0.0)))).head()
    yield f"Total intervals, l_avg:  {total[0] or 0} {(total[1] or 0.0) / (total[0] or 1):12.3f}"


def search(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """The lines of the report that is asked for."""
    store = IntervalStore.open(spark, a.store)
    value = a.value if store.has_value else 0
    if a.mode is None:
        raise SystemExit("one of -q, -r and -m is needed")
    if a.full and a.mode not in ("queries", "region"):
        yield "Not supported -f option"
        return
    if a.mode == "matrix":
        with open(a.out, "w") as f:
            f.writelines(line + "\n" for line in sinks.matrix_lines(store.matrix(value), store.dataset_ids, value))
        return
    if a.mode == "region":
        contig, start, end = a.region[0], int(a.region[1]), int(a.region[2])
        if not a.full:
            yield from sinks.region_report(store.search(contig, start, end, value))
            return
        queries = overlap.literal_queries(spark, [(contig, start, end)])
    elif a.queries:
        queries = bed.read_queries(spark, a.queries)
    else:
        raise SystemExit("no query file")
    if a.full:
        yield from sinks.full_report(queries, store.contigs, store.full_hits(queries))
    elif a.mode == "similarity":
        yield from sinks.similarity_report(store.similarity(queries))
    else:
        yield from sinks.hit_report(store.count_hits(queries, value))


def lines(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    a = _parser().parse_args(argv)
    return (create if a.command == "create" else search)(spark, a)


def main(argv: list[str] | None = None) -> None:
    with scope():
        for line in lines(SparkSession.builder.appName("spanloom").getOrCreate(), sys.argv[1:] if argv is None else argv):
            print(line)


if __name__ == "__main__":
    main()
