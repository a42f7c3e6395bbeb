"""Reading folders, lists and single files of tab-separated region lines, plain or gzip.

Every reader is lazy; only the list of files (not their content) is held by the driver. Lines are parsed one by one, so a short
line never affects the next; columns beyond the fifth are ignored. Rows with start >= end are kept here, since the datasets'
statistics count them; a store drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.parsing import END_LIMIT, basename, parse_bed
from spanloom.plans.strategy import BROADCAST_ROWS, looked_up
from spanloom.shared import written

#: Files whose ids are broadcast at once; more are read in several parts.
CATALOGUE = BROADCAST_ROWS


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted files of a glob pattern or folder, hidden ones left out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(path) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in inside if not s.isDirectory() and not s.getPath().getName().startswith((".", "_"))]
    return sorted(p.toString() for p in found)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], "line string, path string, block long")
    # Only line feeds end a line; a carriage return before one is cut when the line is parsed.
    return spark.read.text(files, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _catalogue(spark: SparkSession, files: list[str]) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    rows = [(i, at(f).toUri().toString(), f) for i, f in enumerate(files)]
    return spark.createDataFrame(rows, "ds_idx int, path string, name string").withColumn("file", basename(F.col("name")))


def _rows(spark: SparkSession, files: list[str], strict: bool, with_value: bool) -> tuple[DataFrame, DataFrame]:
    """The lines of all files with their ids, which are broadcast: their number is known here, and lines never move to get them."""
    names, rows = _catalogue(spark, files), None
    value = [F.col("p.value").alias("value")] if with_value else []
    for k in range(0, max(1, len(files)), CATALOGUE):
        some = files[k : k + CATALOGUE]
        ids = F.broadcast(_catalogue(spark, some).select((F.col("ds_idx") + k).alias("ds_idx"), "path"))
        # A file that is listed more than once is read once and joined with each of its ids.
        part = _lines(spark, list(dict.fromkeys(some))).withColumn("p", parse_bed(F.col("line"), strict)).where("p.ok").join(ids, "path")
        part = part.select(F.col("p.contig").alias("contig"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), *value, "ds_idx")
        rows = part if rows is None else rows.unionByName(part)
    return rows, names.select("ds_idx", "file")


def read_folder(spark: SparkSession, pattern: str, with_value: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(regions, files) of all files that match; a file's id is its place in name order, empty files keep theirs."""
    return _rows(spark, listed(spark, pattern), strict, with_value)


def read_folder_list(spark: SparkSession, path: str, with_value: bool = True) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_folder`, of every folder or pattern that the text file names, in its order."""
    files = [f for (folder,) in _list(spark, path) for f in listed(spark, folder)]
    return _rows(spark, files, False, with_value)


def _list(spark: SparkSession, path: str) -> list[tuple[str]]:
    lines = spark.read.text(path, wholetext=True).head()
    return [(x.strip(),) for x in (lines[0] if lines else "").splitlines() if x.strip()]


def read_list(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(regions, files) of the files that a text file lists, in its order.

    With ``validate``, files that don't exist or whose first line isn't a strict region line are dropped before ids are
    given, lines are parsed strictly and regions outside 0 <= start, end < END_LIMIT are left out.
    """
    wanted = [f for (name,) in _list(spark, path) for f in listed(spark, name)[:1]]
    if not validate:
        return _rows(spark, wanted, False, True)
    numbered = _lines(spark, list(dict.fromkeys(wanted))).withColumn("i", F.monotonically_increasing_id())
    first = numbered.groupBy("path").agg(F.min_by("line", F.struct("block", "i")).alias("line"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    good = {r.path for r in first.where(parse_bed(F.col("line"))["ok"]).select("path").toLocalIterator()}
    rows, names = _rows(spark, [f for f in wanted if at(f).toUri().toString() in good], True, True)
    return rows.where((F.col("start") >= 0) & (F.col("end") < END_LIMIT)), names


def read_named(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(regions, datasets) of one file whose fourth column names the dataset; ids by first appearance.

    Lines of fewer than four fields are left out.
    """
    at = F.struct("block", F.monotonically_increasing_id().alias("i"))
    parsed = _lines(spark, listed(spark, path)).withColumn("at", at).withColumn("p", parse_bed(F.col("line"), False)).where("p.ok AND p.name IS NOT NULL")
    names = parsed.groupBy(F.col("p.name").alias("file")).agg(F.min("at").alias("at"))
    # One row a dataset: the names, not the regions, are numbered in one place.
    names = written(names.select((F.row_number().over(W.orderBy("at")) - 1).alias("ds_idx"), "file"), "names")
    rows = looked_up(parsed.select("p.contig", "p.start", "p.end", "p.value", F.col("p.name").alias("file")), names, ["file"])
    return rows.select("contig", "start", "end", "value", "ds_idx"), names


def read_queries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(q_id, contig, start, end) of a query file; ids are unique and follow the file's order within a block."""
    parsed = _lines(spark, listed(spark, path)).withColumn("q_id", F.monotonically_increasing_id()).withColumn("p", parse_bed(F.col("line"), strict)).where("p.ok")
    return parsed.select("q_id", "p.contig", "p.start", "p.end")


def read_regions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, contig, start, end) of the first three columns of a headless table, without any check of the contig."""
    raw = spark.read.csv(path, sep="\t", schema="contig string, start long, end long")
    return raw.withColumn("q_id", F.monotonically_increasing_id()).select("q_id", "contig", "start", "end")
