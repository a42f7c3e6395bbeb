"""Text reports of search results."""

from __future__ import annotations

import sys
from itertools import groupby, repeat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of lines that a task holds at once.
PART = 1 << 22


def index_tsv(datasets: DataFrame, path: str) -> None:
    """The catalogue as a tab-separated table with a header line, in id order."""
    out = datasets.select(F.col("ds_idx").alias("Index"), F.col("file").alias("File"), F.col("n_regions").alias("Number of regions"), F.format_string("%f", F.coalesce("avg_size", F.lit(float("nan")))).alias("Avg size"))
    out.orderBy("Index").coalesce(1).write.mode("errorifexists").csv(path, sep="\t", header=True)


def read_index_tsv(spark, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, schema="ds_idx int, file string, n_regions long, avg_size double")
    return raw


#: The header lines of the reports and of the index table.
HITS_HEADER = "index\t number of regions\t number of hits\t File_name"
SIMILARITY_HEADER = "index\t number of regions\t similarity\t dataset name"
INDEX_HEADER = "Index\tFile\tNumber of regions\tAvg size"


def index_lines(datasets: DataFrame):
    """The catalogue as lines of a tab-separated table, in id order. A generator over rows, one for each dataset."""
    yield INDEX_HEADER
    for r in datasets.select("ds_idx", "file", "n_regions", "avg_size").orderBy("ds_idx").toLocalIterator():
        yield f"{r.ds_idx}\t{r.file}\t{r.n_regions}\t{float('nan') if r.avg_size is None else r.avg_size:f}"


def hit_report(hits: DataFrame):
    """Datasets with hits, and the total."""
    yield HITS_HEADER
    total = 0
    for r in hits.where("n_hits > 0").orderBy("ds_idx").toLocalIterator():
        yield f"{r.ds_idx}\t{r.n_regions}\t{r.n_hits}\t{r.file}"
        total += r.n_hits
    yield f"Total: {total}"


def region_report(hits: DataFrame):
    """All datasets with their hits of one region."""
    yield HITS_HEADER
    for r in hits.orderBy("ds_idx").toLocalIterator():
        yield f"{r.ds_idx}\t{r.n_regions}\t{r.n_hits}\t{r.file}"


def similarity_report(similarity: DataFrame):
    yield SIMILARITY_HEADER
    for r in similarity.orderBy("ds_idx").toLocalIterator():
        yield f"{r.ds_idx}\t{r.n_regions}\t{r.similarity:10.6f}\t{r.file}"


def full_report(queries: DataFrame, contigs: DataFrame, hits: DataFrame):
    """Every query of a known contig and its hits, numbered, by start; then their number. A generator over rows, sorted by Spark."""
    known = queries.join(contigs.select("contig"), "contig", "left_semi").select("q_id", "contig", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    rows = known.join(hits.select("q_id", "r_start", "r_end", "file", "ds_idx"), "q_id", "left").orderBy("q_id", "r_start", "r_end", "ds_idx")
    at, i, total = None, 0, 0
    for r in rows.toLocalIterator():
        if r.q_id != at:
            yield f"Query {r.contig}, {r.q_start}, {r.q_end}: "
            at, i = r.q_id, 0
        if r.r_start is not None:
            yield f"{i}\t {r.r_start}\t {r.r_end}\t {r.file}"
            i, total = i + 1, total + 1
    yield f"Total overlaps: {total}"


def write_files(lines: DataFrame, folder: str, file: str = "file", order: str = "line_no", line: str = "line") -> None:
    """One text file for each name in ``file``, packed where the name ends so, its lines in ``order``. Rows with a null in any of
    them are left out.

    A file is written by one task, as lines in order must be.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = lines.where(F.col(file).isNotNull() & F.col(order).isNotNull() & F.col(line).isNotNull())
    packed = F.col(file).endswith(".gz")
    fs.mkdirs(path)
    for some, codec in ((rows.where(packed), "gzip"), (rows.where(~packed), "none")):
        parts = f"{folder.rstrip('/')}.{codec}"
        placed = some.repartition(F.col(file)).sortWithinPartitions(file, order)
        placed.select(F.col(file).alias("__file"), F.col(line).alias("value")).write.partitionBy("__file").text(parts, compression=codec, lineSep="\n")
        for d in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)):
            if d.isDirectory():
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(d.getPath().getName().partition("=")[2])
                for part in fs.listStatus(d.getPath()):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(path, name))
        fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def _in_lines(cells, n: int):
    """(x, line) of each run of cells (x, y, count), which come in order; a y below 0 only says that there is such a line."""
    empty = "0\t" * n
    for x, own in groupby(cells, key=lambda c: c[0]):
        pieces, upto = [], 0
        for _, y, count in own:
            if y >= 0:
                pieces += empty[: 2 * (y - upto)], f"{count}\t"
                upto = y + 1
        yield x, "".join((*pieces, empty[: 2 * (n - upto)]))


def matrix_lines(matrix: DataFrame, ids: list, value_above: int):
    """The dense matrix as text: a line with both sizes and the threshold, then a line for each of the ids, which are in order. A
    generator over rows."""
    n, of, at = len(ids), {x: i for i, x in enumerate(ids) if x is not None}, 0
    yield f"{n}\t{n}\t{value_above}"
    rows = ((of[a], of[b], c) for a, b, c in matrix.orderBy("ds_a", "ds_b").toLocalIterator() if a in of and b in of)
    empty = "0\t" * n
    for x, line in _in_lines(rows, n):
        yield from repeat(empty, x - at)
        yield line
        at = x + 1
    yield from repeat(empty, n - at)


def matrix_table(matrix: DataFrame, ids: list, value_above: int) -> DataFrame:
    """:func:`matrix_lines` as a table (line_no, line). Its lines, in length and number as many as the datasets, are made by the
    tasks one at a time; the driver holds the ids."""
    spark, n = matrix.sparkSession, len(ids)
    places = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("at", T.LongType()), T.StructField("ds", matrix.schema["ds_a"].dataType)]))
    x, y = (places.select(F.col("at").alias(c), F.col("ds").alias(f"ds_{ds}")) for c, ds in (("x", "a"), ("y", "b")))
    cells = matrix.join(x, "ds_a").join(y, "ds_b").select("x", "y", "n")
    cells = cells.unionByName(x.select("x", F.lit(-1).cast("long").alias("y"), F.lit(0).cast("long").alias("n")))

    def lines(batches):
        rows = (c for b in batches for c in zip(*(v.to_pylist() for v in b.columns), strict=True))
        at, out, size = [], [], 0
        for x, line in _in_lines(rows, n):
            at.append(x + 1)
            out.append(line)
            size += len(line)
            if size >= PART:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out)], ["line_no", "line"])
                at, out, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.string())], ["line_no", "line"])

    columns = "line_no long, line string"
    body = cells.repartition("x").sortWithinPartitions("x", "y").mapInArrow(lines, columns)
    return spark.createDataFrame([(0, f"{n}\t{n}\t{value_above}")], columns).unionByName(body)
