"""Registered queries from files to reports: folders, lists, stores, both layouts and the command line, with their SQL.

Each writes what it needs into the shared folder once for a session and reads it back through the public readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.functions.parsing import END_LIMIT
from spanloom.shared import removed_at_exit, shared_dir
from spanloom.sources import bed, sinks
from spanloom.sources.store import IntervalStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MADE: dict[tuple[str, str, str], str] = {}

REGION = ("chr1", 120000000, 121500000)
MIN_VALUE = 400


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _once(spark: SparkSession, d: str, name: str, make: Callable[[str], None]) -> str:
    """A place in the shared folder that ``make`` filled, the first time that this session asks for it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        path = removed_at_exit(spark, f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex}")
        make(path)
        _MADE[key] = path
    return _MADE[key]


def _as_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """The lines of a report, numbered; a report has one for each dataset, or for each hit of its queries."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")


def _folder(spark: SparkSession, d: str) -> str:
    return _once(spark, d, "folder", lambda path: sinks.write_files(_table(spark, d, "bed_lines"), path))


def _text(spark: SparkSession, d: str, name: str, lines: Iterable[str]) -> str:
    return _once(spark, d, name, lambda path: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path, lineSep="\n"))


#: Lines split into fields, with the readers' integers, and the files' ids in name order.
def _int(field: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({field}, '^[ \\t\\n\\x0B\\f\\r]*([+-]?[0-9]+)', 1) AS BIGINT), 0)"


_F = f"""l AS (SELECT line_id, file, line_no, string_split(regexp_replace(line, '\\r+$', ''), chr(9)) AS f FROM bed_lines WHERE line IS NOT NULL AND file IS NOT NULL AND line_no IS NOT NULL),
p AS (SELECT *, f[1] AS contig, {_int("f[2]")} AS s, {_int("f[3]")} AS e, coalesce(TRY_CAST({_int("f[5]")} AS INT), 0) AS v, f[4] AS name, len(f) >= 3 AS ok,
 len(f) >= 3 AND starts_with(f[1], 'chr') AND length(f[1]) < 40 AND {_int("f[3]")} > 0 AS strict FROM l),
names AS (SELECT file, (row_number() OVER (ORDER BY file) - 1)::int AS ds_idx FROM (SELECT DISTINCT file FROM l))"""
_COLUMNS = 'contig, s AS start, e AS "end"'


# Readers


@_query(f"WITH {_F} SELECT {_COLUMNS}, v AS value, ds_idx FROM p JOIN names USING (file) WHERE ok")
def read_folder(spark, d):
    return bed.read_folder(spark, _folder(spark, d))[0]


@_query(f"WITH {_F} SELECT ds_idx, file FROM names")
def read_folder_catalogue(spark, d):
    return bed.read_folder(spark, _folder(spark, d) + "/*")[1]


@_query(f"WITH {_F} SELECT {_COLUMNS}, ds_idx FROM p JOIN names USING (file) WHERE ok")
def read_folder_without_values(spark, d):
    return bed.read_folder(spark, _folder(spark, d), with_value=False)[0]


@_query(f"WITH {_F}, n AS (SELECT count(*) AS n FROM names) SELECT {_COLUMNS}, v AS value, (ds_idx + k * n)::int AS ds_idx FROM p JOIN names USING (file) CROSS JOIN n CROSS JOIN (VALUES (0), (1)) AS twice(k) WHERE ok")
def read_folder_list(spark, d):
    """A list that names the folder twice, as a folder and as a pattern."""
    folder = _folder(spark, d)
    return bed.read_folder_list(spark, _text(spark, d, "folders", [folder, "", folder + "/*"]))[0]


def _listed(spark, d) -> str:
    """A list of the files in falling order of their names, and of one that doesn't exist."""
    files = sorted(bed.listed(spark, _folder(spark, d)), reverse=True)
    return _text(spark, d, "files", [*files[:3], _folder(spark, d) + "/missing.bed", *files[3:]])


_GOOD = f"""{_F}, good AS (SELECT file, (row_number() OVER (ORDER BY file DESC) - 1)::int AS ds_idx FROM (SELECT file, arg_min(strict, line_no) AS ok FROM p GROUP BY 1) WHERE ok)"""


@_query(f"WITH {_GOOD} SELECT {_COLUMNS}, v AS value, good.ds_idx FROM p JOIN good USING (file) WHERE strict AND s >= 0 AND e < {END_LIMIT}")
def read_file_list(spark, d):
    return bed.read_list(spark, _listed(spark, d))[0]


@_query(f"WITH {_GOOD} SELECT ds_idx, file FROM good")
def read_file_list_catalogue(spark, d):
    return bed.read_list(spark, _listed(spark, d))[1]


@_query(f"WITH {_F}, n AS (SELECT count(*) AS n FROM names) SELECT {_COLUMNS}, v AS value, (n - 1 - ds_idx)::int AS ds_idx FROM p JOIN names USING (file) CROSS JOIN n WHERE ok")
def read_file_list_unchecked(spark, d):
    return bed.read_list(spark, _listed(spark, d), validate=False)[0]


def _one_file(spark, d) -> str:
    return _once(spark, d, "one", lambda path: sinks.write_files(_table(spark, d, "bed_lines").withColumn("one", F.lit("all.bed")), path, "one", "line_id")) + "/all.bed"


_NAMED = f"""{_F}, first AS (SELECT name, min(line_id) AS place FROM p WHERE ok AND name IS NOT NULL GROUP BY 1), ids AS (SELECT name, (row_number() OVER (ORDER BY place) - 1)::int AS ds_idx FROM first)""".replace(
    " WHERE line IS NOT NULL AND file IS NOT NULL AND line_no IS NOT NULL", " WHERE line IS NOT NULL"
)


@_query(f"WITH {_NAMED} SELECT {_COLUMNS}, v AS value, ids.ds_idx FROM p JOIN ids USING (name) WHERE ok")
def read_named(spark, d):
    return bed.read_named(spark, _one_file(spark, d))[0]


@_query(f"WITH {_NAMED} SELECT ds_idx, name AS file FROM ids")
def read_named_catalogue(spark, d):
    return bed.read_named(spark, _one_file(spark, d))[1]


@_query(f"WITH {_F} SELECT {_COLUMNS} FROM p WHERE strict".replace(" AND file IS NOT NULL AND line_no IS NOT NULL", ""))
def read_query_file(spark, d):
    return bed.read_queries(spark, _one_file(spark, d)).drop("q_id")


def _query_file(spark, d) -> str:
    """The queries as a text file, those without a start left out."""
    q = _table(spark, d, "queries").where("contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    lines = q.select(F.lit("q.bed").alias("file"), "q_id", F.concat_ws("\t", "contig", "start", "end").alias("line"))
    return _once(spark, d, "queries", lambda path: sinks.write_files(lines, path, "file", "q_id")) + "/q.bed"


@_query('SELECT contig, start, "end" FROM queries WHERE contig IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL')
def read_query_table(spark, d):
    return bed.read_regions_csv(spark, _query_file(spark, d)).drop("q_id")


# Stores


def _store(spark, d) -> IntervalStore:
    def make(path):
        IntervalStore.create(spark, path, _table(spark, d, "intervals").select("contig", "start", "end", F.coalesce("value", F.lit(0)).alias("value"), "ds_idx"), _table(spark, d, "datasets"))

    return IntervalStore.open(spark, _once(spark, d, "store", make))


def _tile_store(spark, d) -> IntervalStore:
    return IntervalStore.open(spark, _once(spark, d, "tiles", lambda path: _store(spark, d).save_file(path)))


_R = """r AS (SELECT contig, start AS rs, "end" AS re, coalesce(value, 0) AS value, ds_idx FROM intervals WHERE start < "end" AND contig IS NOT NULL)"""
_Q = """q AS (SELECT q_id, contig, start AS qs, "end" AS qe FROM queries WHERE start IS NOT NULL AND "end" IS NOT NULL)"""
_ON = "q.contig = r.contig AND r.rs < q.qe AND r.re > q.qs"
_D = """i AS (SELECT d.ds_idx, d.file, count(v.contig) AS n_regions, avg("end" - start) AS avg_size, count(*) FILTER (start < "end") AS n_stored
 FROM datasets AS d LEFT JOIN (SELECT ds_idx, start, "end", coalesce(contig, '') AS contig FROM intervals) AS v USING (ds_idx) GROUP BY 1, 2)"""
_T = """tiled AS (SELECT *, unnest(range(greatest(rs, 0) // 16384, greatest(re - 1, rs, 0) // 16384 + 1)) AS tile FROM r)"""
_H = f"h AS (SELECT ds_idx, count(*) AS n FROM q JOIN r ON {_ON} GROUP BY 1)"
_ONE = f"h AS (SELECT ds_idx, count(*) AS n FROM r WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]} GROUP BY 1)"


@_query(f"WITH {_D} SELECT ds_idx, file, n_regions, round(avg_size, 6) AS avg_size, n_stored FROM i")
def store_datasets(spark, d):
    return _store(spark, d).datasets.withColumn("avg_size", F.round("avg_size", 6))


@_query(f"WITH {_R}, {_T} SELECT (row_number() OVER (ORDER BY contig) - 1)::int AS contig_id, contig, max(tile) + 1 AS n_tiles FROM tiled GROUP BY contig")
def store_contigs(spark, d):
    return _store(spark, d).contigs


@_query(f"WITH {_R}, {_D} SELECT 16384 AS bin_size, true AS has_value, (SELECT count(DISTINCT contig) FROM r) AS n_contigs, (SELECT count(*) FROM i) AS n_datasets, (SELECT count(DISTINCT contig) FROM r WHERE contig < 'chr7') AS chr7, -1 AS none")
def store_facts(spark, d):
    s = _store(spark, d)
    return spark.createDataFrame([(s.bin_size, s.has_value, s.n_contigs, s.n_datasets, s.contig_id("chr7"), s.contig_id("no such"))], "bin_size int, has_value boolean, n_contigs long, n_datasets long, chr7 long, none int")


@_query(f"WITH {_R} SELECT 0::bigint AS n_inversions, count(*) AS n FROM r")
def store_order(spark, d):
    """Rows of the store's files that don't follow the one before by contig and start: none."""
    from pyspark.sql.window import Window as W

    rows = _store(spark, d).intervals.select("contig", "start", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    before = F.lag(F.struct("contig", "start")).over(W.partitionBy("file").orderBy("i"))
    return rows.select((before > F.struct("contig", "start")).alias("x")).agg(F.count_if("x").alias("n_inversions"), F.count("*").alias("n"))


@_query(f"WITH {_R}, {_Q}, {_D}, {_H} SELECT ds_idx, file, n_regions, coalesce(n, 0) AS n_hits FROM i LEFT JOIN h USING (ds_idx)")
def store_count_hits(spark, d):
    return _store(spark, d).count_hits(_table(spark, d, "queries"))


@_query(f"WITH {_R}, {_Q}, {_D}, {_H.replace(' GROUP', f' AND value >= {MIN_VALUE} GROUP')} SELECT ds_idx, file, n_regions, coalesce(n, 0) AS n_hits FROM i LEFT JOIN h USING (ds_idx)")
def store_count_hits_min_value(spark, d):
    return _store(spark, d).count_hits(_table(spark, d, "queries"), MIN_VALUE)


@_query(f"WITH {_R}, {_Q}, {_D} SELECT q_id, q.contig, qs AS q_start, qe AS q_end, rs AS r_start, re AS r_end, ds_idx, file FROM q JOIN r ON {_ON} LEFT JOIN i USING (ds_idx)")
def store_full_hits(spark, d):
    return _store(spark, d).full_hits(_table(spark, d, "queries")).select("q_id", "contig", "q_start", "q_end", "r_start", "r_end", "ds_idx", "file")


@_query(f"WITH {_R}, {_Q}, {_D}, {_H} SELECT ds_idx, 2 * coalesce(n, 0) AS n FROM i LEFT JOIN h USING (ds_idx)")
def store_hit_vector(spark, d):
    """The hits of two searches with the same queries, added up."""
    s, q = _store(spark, d), _table(spark, d, "queries")
    v = s.hit_vector(q, s.hit_vector(q))
    return spark.createDataFrame([(i, int(x)) for i, x in zip(s.dataset_ids, v, strict=True)], "ds_idx int, n long")


_FOUND = f"SELECT contig, rs AS start, re AS \"end\", value, ds_idx FROM r WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]}"


@_query(f"WITH {_R} {_FOUND}")
def store_region(spark, d):
    return _store(spark, d).region(*REGION).select("contig", "start", "end", "value", "ds_idx")


#: The tile with the most records, the first of them by contig and number.
_FULLEST = f"{_R}, {_T}, top AS (SELECT contig, tile FROM tiled GROUP BY 1, 2 ORDER BY count(*) DESC, contig, tile LIMIT 1)"


def _fullest(store: IntervalStore) -> tuple[int, int]:
    """Contig and tile number, from 1, of the tile with the most records."""
    top = store.tile_histogram().orderBy(F.desc("n"), "contig", "tile").limit(1).head()
    return store.contig_id(top.contig) + 1, top.tile + 1


@_query(f'WITH {_FULLEST} SELECT ds_idx, rs AS start, re AS "end" FROM tiled JOIN top USING (contig, tile)')
def store_bin_data(spark, d):
    s = _store(spark, d)
    return s.bin_data(*_fullest(s))


@_query(f"WITH {_FULLEST} SELECT count(*) AS n, true AS beyond, true AS below FROM tiled JOIN top USING (contig, tile)")
def store_bin_len(spark, d):
    s = _store(spark, d)
    contig, tile = _fullest(s)
    return spark.createDataFrame([(s.bin_len(contig, tile), s.bin_len(contig, 1 << 40) is None, s.bin_len(0, 1) is None)], "n long, beyond boolean, below boolean")


_PAIR = "FROM r AS a JOIN r AS b ON a.contig = b.contig AND a.rs < b.re AND a.re > b.rs"


@_query(f"WITH {_R} SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} GROUP BY 1, 2")
def store_matrix(spark, d):
    return _store(spark, d).matrix()


# The binary layout


@_query(f"WITH {_R} SELECT contig, rs AS start, re AS \"end\", value, ds_idx FROM r")
def tile_file_rows(spark, d):
    return _tile_store(spark, d).intervals.drop("r_id")


@_query(f"WITH {_R}, {_T} SELECT contig, tile, count(*) AS n FROM tiled GROUP BY 1, 2")
def tile_file_copies(spark, d):
    s = _tile_store(spark, d)
    return s._read(copies="true").groupBy("contig", "tile").agg(F.count("*").alias("n"))


@_query(f"WITH {_D} SELECT ds_idx, file, n_regions, round(avg_size, 4) AS avg_size FROM i")
def tile_file_datasets(spark, d):
    return _tile_store(spark, d).datasets.withColumn("avg_size", F.round("avg_size", 4))


@_query(f"WITH {_R} {_FOUND}")
def tile_file_region(spark, d):
    return _tile_store(spark, d).region(*REGION).select("contig", "start", "end", "value", "ds_idx")


@_query(f"WITH {_R}, {_Q}, {_D}, {_H} SELECT ds_idx, file, n_regions, coalesce(n, 0) AS n_hits FROM i LEFT JOIN h USING (ds_idx)")
def tile_file_count_hits(spark, d):
    return _tile_store(spark, d).count_hits(_table(spark, d, "queries"))


# The command line


def _search(spark, d, *flags: str) -> DataFrame:
    return _as_lines(spark, cli.lines(spark, ["search", _store(spark, d).path, *flags]))


def _report(ctes: str, header: str, rows: str, order: str, footer: str | None = None) -> str:
    end = f" UNION ALL SELECT 1 + (SELECT count(*) FROM body), {footer}" if footer else ""
    return f"WITH {ctes}, body AS ({rows}) SELECT 0 AS line_no, {header} AS line UNION ALL SELECT row_number() OVER (ORDER BY {order}), line FROM body{end}"


_TAB = "chr(9)"
_HITS_HEADER = "'index' || chr(9) || ' number of regions' || chr(9) || ' number of hits' || chr(9) || ' File_name'"
_STRICT_Q = """q AS (SELECT q_id, contig, start AS qs, "end" AS qe FROM queries WHERE start IS NOT NULL AND "end" > 0 AND starts_with(contig, 'chr') AND length(contig) < 40)"""
_HIT_LINE = f"ds_idx || {_TAB} || n_regions || {_TAB} || coalesce(n, 0) || {_TAB} || file AS line"


@_query(_report(f"{_R}, {_STRICT_Q}, {_D}, {_H}", _HITS_HEADER, f"SELECT ds_idx, n, {_HIT_LINE} FROM i JOIN h USING (ds_idx)", "ds_idx", "'Total: ' || (SELECT coalesce(sum(n), 0)::bigint FROM body)"))
def report_hits(spark, d):
    return _search(spark, d, "-q", _query_file(spark, d))


@_query(_report(f"{_R}, {_D}, {_ONE}", _HITS_HEADER, f"SELECT ds_idx, {_HIT_LINE} FROM i LEFT JOIN h USING (ds_idx)", "ds_idx"))
def report_region(spark, d):
    return _search(spark, d, "-q", _query_file(spark, d), "-r", REGION[0], str(REGION[1]), str(REGION[2]))


@_query(
    f"""WITH {_R}, {_D}, b AS (SELECT row_number() OVER (ORDER BY rs, re, r.ds_idx) AS i, rs, re, file FROM r LEFT JOIN i USING (ds_idx) WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]})
SELECT 0 AS line_no, 'Query {REGION[0]}, {REGION[1]}, {REGION[2]}: ' AS line UNION ALL SELECT i, (i - 1) || chr(9) || ' ' || rs || chr(9) || ' ' || re || chr(9) || ' ' || file FROM b UNION ALL SELECT (SELECT count(*) FROM b) + 1, 'Total overlaps: ' || (SELECT count(*) FROM b)"""
)
def report_full_hits(spark, d):
    return _search(spark, d, "-r", REGION[0], str(REGION[1]), str(REGION[2]), "-f")


@_query(
    _report(
        f"{_R}, {_D}, c AS (SELECT a.ds_idx AS x, b.ds_idx AS y, count(*) AS n {_PAIR} AND a.value > {MIN_VALUE} AND b.value > {MIN_VALUE} GROUP BY 1, 2)",
        f"(SELECT count(*) FROM i) || {_TAB} || (SELECT count(*) FROM i) || {_TAB} || {MIN_VALUE}",
        f"SELECT a.ds_idx AS x, string_agg(coalesce(n, 0) || {_TAB}, '' ORDER BY b.ds_idx) AS line FROM i AS a CROSS JOIN i AS b LEFT JOIN c ON c.x = a.ds_idx AND c.y = b.ds_idx GROUP BY 1",
        "x",
    )
)
def report_matrix(spark, d):
    s = _store(spark, d)
    return sinks.matrix_table(s.matrix(MIN_VALUE), s.dataset_ids, MIN_VALUE)


@_query(_report(_D, f"'Index' || {_TAB} || 'File' || {_TAB} || 'Number of regions' || {_TAB} || 'Avg size'", f"SELECT ds_idx, ds_idx || {_TAB} || file || {_TAB} || n_regions || {_TAB} || CASE WHEN avg_size IS NULL THEN 'nan' ELSE printf('%.6f', avg_size) END AS line FROM i", "ds_idx"))
def report_index(spark, d):
    return _as_lines(spark, sinks.index_lines(_store(spark, d).datasets))


@_query(f"WITH {_F}, m AS (SELECT count(*) AS n, avg(e - s) AS a FROM p WHERE ok) SELECT 0::BIGINT AS line_no, 'Total intervals, l_avg:  ' || n || ' ' || lpad(printf('%.3f', a), greatest(12, len(printf('%.3f', a)))::int, ' ') AS line FROM m")
def report_create(spark, d):
    """The summary that the command prints when it has built a store of a folder."""
    place = removed_at_exit(spark, f"{shared_dir(spark)}/spanloom-created-{uuid.uuid4().hex}")
    return _as_lines(spark, cli.lines(spark, ["create", _folder(spark, d), *place.rsplit("/", 1)]))


@_query("SELECT p::int AS power, (CASE WHEN p BETWEEN 11 AND 19 THEN 2 ** p ELSE 16384 END)::int AS bin_size FROM range(-1, 33) AS t(p)")
def tile_widths(spark, d):
    return spark.createDataFrame([(p, cli.bin_size(p)) for p in range(-1, 33)], "power int, bin_size int")


__all__ = ["QUERIES", "SQL"]
