"""Registered queries over the test tables, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import explode_tiles, lenient_int, parse_bed
from spanloom.functions.parsing import END_LIMIT, basename
from spanloom.operators import faulty, matching, matrix, overlap, periods, ranked, skew, stats

REGION = ("chr1", 120000000, 121500000)
REGIONS = [("chr1", 120000000, 120500000), ("chr2", 40000000, 41000000), ("chr2", 40500000, 40500000), ("chrNone", 1, 10), ("chrX", 100, 300000)]
MIN_VALUE = 400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _r(spark: SparkSession, d: str) -> DataFrame:
    return overlap.stored(table(spark, d, "intervals"))


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries")


#: The same two tables in SQL.
_R = """r AS (SELECT r_id, contig, start AS rs, "end" AS re, coalesce(value, 0) AS value, ds_idx FROM intervals WHERE start < "end")"""
_Q = """q AS (SELECT q_id, contig, start AS qs, "end" AS qe FROM queries WHERE start IS NOT NULL AND "end" IS NOT NULL)"""
_ON = "q.contig = r.contig AND r.rs < q.qe AND r.re > q.qs"
_T = "greatest({0}, 0) // {1}"
_TILES = """tiled AS (SELECT *, unnest(range(greatest(rs, 0) // 16384, greatest(re - 1, rs, 0) // 16384 + 1)) AS tile FROM r)"""
_EVENTS = """SELECT 'chr' || (user_id % 48)::varchar AS contig, epoch_us(ts) // 1000000 - 1704067200 AS rs,
 epoch_us(ts) // 1000000 - 1704067200 + 1 + floor(value * 60)::bigint AS re, event_type AS ds_idx, floor(value)::int AS value, event_id AS r_id FROM events"""
_LINES = """SELECT 'chr' || (l_suppkey % 22 + 1)::varchar AS contig, floor(l_extendedprice * 10)::bigint AS rs,
 floor(l_extendedprice * 10)::bigint + floor(l_quantity * 20)::bigint AS re, l_linenumber AS ds_idx, floor(l_discount * 1000)::int AS value FROM lineitem"""
_ORDERS = """SELECT 'chr' || (o_custkey % 50)::varchar AS contig, floor(o_totalprice * 5)::bigint AS qs,
 floor(o_totalprice * 5)::bigint + 200 + (o_orderkey % 9) * 9000 AS qe, o_orderkey AS q_id FROM orders"""


def events_regions(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as regions: sparse."""
    at = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
    return table(spark, d, "events").selectExpr(
        "concat('chr', cast(user_id % 48 AS string)) contig", f"{at} start", f"{at} + 1 + floor(value * 60) end", "event_type ds_idx", "cast(floor(value) AS int) value", "event_id r_id"
    )


def line_regions(spark: SparkSession, d: str) -> DataFrame:
    """The line item table read as regions: dense, without an id."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('chr', cast(l_suppkey % 22 + 1 AS string)) contig", "floor(l_extendedprice * 10) start", "floor(l_extendedprice * 10) + floor(l_quantity * 20) end", "l_linenumber ds_idx", "cast(floor(l_discount * 1000) AS int) value"
    )


def order_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every order read as a query region."""
    return table(spark, d, "orders").selectExpr(
        "concat('chr', cast(o_custkey % 50 AS string)) contig", "floor(o_totalprice * 5) start", "floor(o_totalprice * 5) + 200 + (o_orderkey % 9) * 9000 end", "o_orderkey q_id"
    )


# Overlap joins


@_query(f"WITH {_R}, {_Q} SELECT q_id, q.contig, qs AS q_start, qe AS q_end, rs AS r_start, re AS r_end, value, r_id, ds_idx FROM q JOIN r ON {_ON}")
def overlap_pairs(spark, d):
    return overlap.pairs(_q(spark, d), _r(spark, d))


@_query(f"WITH {_R}, {_Q} SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits(spark, d):
    return overlap.count_hits(_q(spark, d), _r(spark, d))


@_query(f"WITH {_R}, {_Q}, h AS (SELECT ds_idx, count(*) AS n FROM q JOIN r ON {_ON} GROUP BY 1) SELECT ds_idx, n AS n_hits, file FROM h JOIN datasets USING (ds_idx)")
def count_hits_nonzero(spark, d):
    return overlap.count_hits_dense(_q(spark, d), _r(spark, d), table(spark, d, "datasets")).where("n_hits > 0")


@_query(f"WITH {_R}, {_Q}, h AS (SELECT ds_idx, count(*) AS n FROM q JOIN r ON {_ON} GROUP BY 1) SELECT ds_idx, coalesce(n, 0) AS n_hits, file FROM datasets LEFT JOIN h USING (ds_idx)")
def count_hits_dense(spark, d):
    return overlap.count_hits_dense(_q(spark, d), _r(spark, d), table(spark, d, "datasets"))


@_query(f"WITH {_R}, {_Q} SELECT count(*) AS total FROM q JOIN r ON {_ON}")
def hits_total(spark, d):
    return overlap.count_hits(_q(spark, d), _r(spark, d)).agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("total"))


@_query(f"WITH {_R}, {_Q} SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} AND value >= {MIN_VALUE} GROUP BY 1")
def count_hits_min_value(spark, d):
    return overlap.count_hits(_q(spark, d), _r(spark, d), min_value=MIN_VALUE)


@_query(f"WITH {_R}, {_Q} SELECT q_id, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_per_query(spark, d):
    return overlap.count_hits_per_query(_q(spark, d), _r(spark, d))


@_query(f"WITH {_R}, {_Q} SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def typeless_overlap(spark, d):
    """A store without values."""
    return overlap.count_hits(_q(spark, d), _r(spark, d).drop("value"))


@_query(f"WITH {_R} SELECT r_id, ds_idx, contig, rs AS start, re AS \"end\", value FROM r WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]}")
def search_region(spark, d):
    return overlap.region(_r(spark, d), *REGION).select("r_id", "ds_idx", "contig", "start", "end", "value")


@_query(f"WITH {_R}, h AS (SELECT ds_idx, count(*) AS n FROM r WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]} GROUP BY 1) SELECT ds_idx, file, coalesce(n, 0) AS n_hits FROM datasets LEFT JOIN h USING (ds_idx)")
def search_region_counts(spark, d):
    return overlap.region_counts(_r(spark, d), table(spark, d, "datasets"), *REGION)


_LITERAL = ", ".join(f"({i}, '{c}', {s}, {e})" for i, (c, s, e) in enumerate(REGIONS))


@_query(f"WITH {_R}, q(q_id, contig, qs, qe) AS (VALUES {_LITERAL}) SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def search_regions_multi(spark, d):
    return overlap.count_hits(overlap.literal_queries(spark, REGIONS), _r(spark, d))


@_query(f"WITH {_R} SELECT rs AS r_start, re AS r_end, file FROM r JOIN datasets USING (ds_idx) WHERE contig = '{REGION[0]}' AND rs < {REGION[2]} AND re > {REGION[1]}")
def region_full_hits(spark, d):
    q = overlap.literal_queries(spark, [REGION])
    return overlap.full_hits(q, _r(spark, d), table(spark, d, "datasets")).select("r_start", "r_end", "file")


@_query(f"WITH {_R}, {_Q}, z AS (SELECT q_id, contig, qs, qs AS qe FROM q) SELECT q.q_id, count(*) AS n_hits FROM z AS q JOIN r ON {_ON} GROUP BY 1")
def zero_length_query(spark, d):
    return overlap.count_hits_per_query(_q(spark, d).withColumn("end", F.when(F.col("end").isNotNull(), F.col("start"))), _r(spark, d))


@_query(
    f"""WITH {_R}, {_Q}, {_TILES}, o AS (SELECT DISTINCT contig, tile FROM tiled)
SELECT ds_idx, count(*) AS n_hits FROM (SELECT * FROM q WHERE EXISTS (SELECT 1 FROM o WHERE o.contig = q.contig AND o.tile = greatest(q.qs, 0) // 16384)) AS q JOIN r ON {_ON} GROUP BY 1"""
)
def compat_empty_first_tile(spark, d):
    return overlap.count_hits(_q(spark, d), _r(spark, d), compat_empty_first_tile=True)


@_query(f"WITH {_R}, {_Q} SELECT q.q_id FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.contig = q.contig)")
def unknown_contig(spark, d):
    q = _q(spark, d).where("start IS NOT NULL AND end IS NOT NULL")
    return q.join(_r(spark, d).select("contig").distinct(), "contig", "left_anti").select("q_id")


@_query(f"WITH {_R}, {_Q} SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_ranked(spark, d):
    return ranked.count_hits_ranked(_q(spark, d), _r(spark, d))


@_query(f"WITH r AS ({_LINES}), q AS ({_ORDERS}) SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_chosen(spark, d):
    """By the join or by ranks, as the tiles' counts say."""
    return ranked.count_hits_chosen(order_queries(spark, d), line_regions(spark, d))


@_query(f"WITH {_R} SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n FROM r AS a JOIN r AS b ON a.contig = b.contig AND a.rs < b.re AND a.re > b.rs GROUP BY 1, 2")
def hit_matrix_ranked_many(spark, d):
    """More datasets than one pass counts."""
    return ranked.hit_matrix_ranked(_r(spark, d))


@_query(f"WITH r AS ({_LINES}), q AS ({_ORDERS}) SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_ranked_lineitem(spark, d):
    return ranked.count_hits_ranked(order_queries(spark, d), line_regions(spark, d))


@_query(f"WITH r AS ({_EVENTS}), q AS ({_ORDERS}) SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_events(spark, d):
    return overlap.count_hits(order_queries(spark, d), events_regions(spark, d))


@_query(f"WITH r AS ({_LINES}), q AS ({_ORDERS}) SELECT ds_idx, count(*) AS n_hits FROM q JOIN r ON {_ON} GROUP BY 1")
def count_hits_lineitem(spark, d):
    return overlap.count_hits(order_queries(spark, d), line_regions(spark, d))


# Matrix

_PAIR = "FROM r AS a JOIN r AS b ON a.contig = b.contig AND a.rs < b.re AND a.re > b.rs"


@_query(f"WITH {_R} SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} GROUP BY 1, 2")
def hit_matrix(spark, d):
    return matrix.hit_matrix(_r(spark, d))


@_query(f"WITH {_R} SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} AND a.value > {MIN_VALUE} AND b.value > {MIN_VALUE} GROUP BY 1, 2")
def hit_matrix_min_value(spark, d):
    return matrix.hit_matrix(_r(spark, d), value_above=MIN_VALUE)


_KINDS = ["click", "error", "purchase", "signup", "view"]


@_query(f"WITH r AS ({_EVENTS}) SELECT a.ds_idx AS ds_a, " + ", ".join(f"count(*) FILTER (b.ds_idx = '{k}') AS d{k}" for k in _KINDS) + f" {_PAIR} GROUP BY 1")
def hit_matrix_dense(spark, d):
    return matrix.dense(matrix.hit_matrix(events_regions(spark, d)), _KINDS)


@_query(f"WITH r AS ({_EVENTS}) SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} GROUP BY 1, 2")
def hit_matrix_events(spark, d):
    return matrix.hit_matrix(events_regions(spark, d))


@_query(f"WITH r AS ({_LINES}) SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} GROUP BY 1, 2")
def hit_matrix_lineitem(spark, d):
    return matrix.hit_matrix(line_regions(spark, d))


@_query(f"WITH r AS ({_EVENTS}) SELECT a.ds_idx AS ds_a, b.ds_idx AS ds_b, count(*) AS n {_PAIR} GROUP BY 1, 2")
def hit_matrix_ranked(spark, d):
    return ranked.hit_matrix_ranked(events_regions(spark, d))


# Similarity

_SM = "((least(qe, re) - greatest(qs, rs))::float / ((qe - qs) + (re - rs) - (least(qe, re) - greatest(qs, rs)))::float)::float"


@_query(f"WITH {_R}, {_Q} SELECT q_id, r_id, ds_idx, round({_SM}::double, 6) AS sm FROM q JOIN r ON {_ON}")
def pair_similarity(spark, d):
    return overlap.pair_similarity(_q(spark, d), _r(spark, d)).select("q_id", "r_id", "ds_idx", F.round(F.col("sm").cast("double"), 6).alias("sm"))


def _matching_sql(regions: str, queries: str) -> str:
    """Mutual-best rounds as a recursive query."""
    return f"""WITH RECURSIVE {regions}, {queries},
it AS (
 SELECT 0 AS round, ds_idx, q_id, qs, r_id, rs, {_SM} AS sm, false AS taken, false AS gone FROM q JOIN r ON {_ON} AND q.qs >= 0 AND q.qs <= q.qe
 UNION ALL
 SELECT round + 1, ds_idx, q_id, qs, r_id, rs, sm, t, bool_or(t) OVER (PARTITION BY ds_idx, q_id) OR bool_or(t) OVER (PARTITION BY ds_idx, r_id) FROM (
  SELECT *, row_number() OVER (PARTITION BY ds_idx, q_id ORDER BY sm DESC, rs, r_id) = 1 AND row_number() OVER (PARTITION BY ds_idx, r_id ORDER BY sm DESC, qs, q_id) = 1 AS t
  FROM it WHERE NOT gone)
),
m AS (SELECT ds_idx, sum(sm::double) AS s, count(*) AS n FROM it WHERE taken GROUP BY 1)
"""


_R_Q = (_R, _Q)


@_query(_matching_sql(*_R_Q) + "SELECT ds_idx, round(s, 6) AS sm_sum, n AS n_matched FROM m")
def matching_sum(spark, d):
    return matching.match_sums(_q(spark, d), _r(spark, d)).withColumn("sm_sum", F.round("sm_sum", 6))


@_query(_matching_sql(f"r AS ({_EVENTS})", f"q AS ({_ORDERS})") + "SELECT ds_idx, round(s, 6) AS sm_sum, n AS n_matched FROM m")
def matching_sum_events(spark, d):
    return matching.match_sums(order_queries(spark, d), events_regions(spark, d)).withColumn("sm_sum", F.round("sm_sum", 6))


@_query(
    _matching_sql(*_R_Q)
    + """, c AS (SELECT ds_idx, count(*) AS nr FROM intervals GROUP BY 1), k AS (SELECT count(*) AS nq FROM q WHERE qs >= 0 AND qs <= qe)
SELECT ds_idx, nr AS n_regions, round(coalesce(s, 0) / (nq + nr - coalesce(s, 0)), 6) AS similarity FROM c CROSS JOIN k LEFT JOIN m USING (ds_idx)"""
)
def matching_similarity(spark, d):
    r = table(spark, d, "intervals")
    return matching.similarity(_q(spark, d), r).withColumn("similarity", F.round("similarity", 6))


# Statistics and introspection


@_query("""SELECT ds_idx, count(*) AS n_regions, round(avg("end" - start), 6) AS avg_size, count(*) FILTER (start < "end") AS n_stored FROM intervals GROUP BY 1""")
def dataset_stats(spark, d):
    return stats.dataset_stats(table(spark, d, "intervals")).withColumn("avg_size", F.round("avg_size", 6))


@_query("""SELECT count(*) AS n_regions, round(avg("end" - start), 6) AS avg_size FROM intervals""")
def global_stats(spark, d):
    return stats.global_stats(table(spark, d, "intervals")).withColumn("avg_size", F.round("avg_size", 6))


@_query(f"WITH {_R}, {_TILES} SELECT r_id, contig, tile FROM tiled")
def tile_assign(spark, d):
    return explode_tiles(_r(spark, d)).select("r_id", "contig", "tile")


@_query(f"WITH {_R}, {_TILES} SELECT contig, tile, count(*) AS n FROM tiled GROUP BY 1, 2")
def tile_histogram(spark, d):
    return stats.tile_histogram(_r(spark, d))


@_query(f"WITH {_R}, {_TILES} SELECT contig, max(tile) + 1 AS n_tiles FROM tiled GROUP BY 1")
def tiles_per_contig(spark, d):
    return stats.tiles_per_contig(_r(spark, d))


@_query(f"WITH {_R}, {_TILES} SELECT count(*) AS n_records FROM tiled")
def replicated_total(spark, d):
    return stats.replicated_total(_r(spark, d))


_BIN = ("chr1", 7400)


@_query(f"WITH {_R}, {_TILES} SELECT count(*) AS n FROM tiled WHERE contig = '{_BIN[0]}' AND tile = {_BIN[1]}")
def bin_len(spark, d):
    return stats.bin_len(_r(spark, d), *_BIN)


@_query(f"WITH {_R}, {_TILES} SELECT ds_idx, rs AS start, re AS \"end\" FROM tiled WHERE contig = '{_BIN[0]}' AND tile = {_BIN[1]}")
def bin_data(spark, d):
    return stats.bin_data(_r(spark, d), *_BIN)


@_query(f"WITH {_R} SELECT (row_number() OVER (ORDER BY contig) - 1)::int AS contig_id, contig FROM (SELECT DISTINCT contig FROM r)")
def contig_dictionary(spark, d):
    return stats.contig_dictionary(_r(spark, d))


@_query("SELECT contig_id FROM contigs WHERE contig = 'chr7' UNION ALL SELECT -1 WHERE NOT EXISTS (SELECT 1 FROM contigs WHERE contig = 'chrNone')")
def contig_id_lookup(spark, d):
    contigs = table(spark, d, "contigs")
    return spark.createDataFrame([(stats.contig_id(contigs, c),) for c in ("chr7", "chrNone")], "contig_id int")


@_query("SELECT count(*) AS n FROM contigs")
def n_contigs(spark, d):
    return table(spark, d, "contigs").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n FROM datasets")
def n_datasets(spark, d):
    return table(spark, d, "datasets").agg(F.count("*").alias("n"))


@_query("SELECT bin_size, has_value FROM meta")
def store_meta(spark, d):
    return table(spark, d, "meta")


@_query("SELECT ds_idx, file, n_regions, avg_size FROM datasets")
def dataset_info(spark, d):
    return table(spark, d, "datasets").select("ds_idx", "file", "n_regions", "avg_size")


@_query(
    f"""WITH {_R}, {_TILES} SELECT contig, tile, r_id, max(re) OVER (PARTITION BY contig, tile ORDER BY rs, re, r_id ROWS UNBOUNDED PRECEDING) AS max_end FROM tiled"""
)
def prefix_max_end(spark, d):
    return stats.prefix_max_end(_r(spark, d))


# Parsing and filters


@_query(f"WITH {_R} SELECT r_id FROM r")
def drop_invalid(spark, d):
    return _r(spark, d).select("r_id")


@_query(f"""SELECT r_id FROM intervals WHERE start >= 0 AND "end" < {END_LIMIT}""")
def range_guard(spark, d):
    return table(spark, d, "intervals").where(f"start >= 0 AND end < {END_LIMIT}").select("r_id")


# A leading integer; one that 64 bits can't hold counts as 0 in both engines.
def _int_sql(field: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({field}, '^[ \\t\\n\\x0B\\f\\r]*([+-]?[0-9]+)', 1) AS BIGINT), 0)"


_SPLIT = "SELECT line_id, string_split(regexp_replace(line, '\\r+$', ''), chr(9)) AS f FROM bed_lines WHERE line IS NOT NULL"


@_query(f"WITH l AS ({_SPLIT}) SELECT line_id, f[1] AS contig, {_int_sql('f[2]')} AS start, {_int_sql('f[3]')} AS \"end\" FROM l WHERE len(f) >= 3 AND starts_with(f[1], 'chr') AND length(f[1]) < 40 AND {_int_sql('f[3]')} > 0")
def strict_bed_parse(spark, d):
    p = table(spark, d, "bed_lines").select("line_id", parse_bed(F.col("line"), strict=True).alias("p"))
    return p.where("p.ok").select("line_id", "p.contig", "p.start", "p.end")


@_query(f"WITH l AS ({_SPLIT}) SELECT line_id, f[1] AS contig, {_int_sql('f[2]')} AS start, {_int_sql('f[3]')} AS \"end\" FROM l WHERE len(f) >= 3")
def lenient_bed_parse(spark, d):
    p = table(spark, d, "bed_lines").select("line_id", parse_bed(F.col("line"), strict=False).alias("p"))
    return p.where("p.ok").select("line_id", "p.contig", "p.start", "p.end")


@_query(f"WITH l AS ({_SPLIT}) SELECT line_id, coalesce(TRY_CAST({_int_sql('f[5]')} AS INT), 0) AS value FROM l")
def score_parse_default(spark, d):
    lines = table(spark, d, "bed_lines").where("line IS NOT NULL")
    return lines.select("line_id", parse_bed(F.col("line"), strict=False)["value"].alias("value"))


@_query("SELECT file, string_split('in/bed/' || file, '/')[-1] AS base FROM datasets")
def file_basename(spark, d):
    return table(spark, d, "datasets").select("file", basename(F.concat(F.lit("in/bed/"), "file")).alias("base"))


@_query("SELECT contig, count(*) AS n FROM (SELECT contig FROM intervals UNION ALL SELECT contig FROM queries) GROUP BY 1")
def union_sources(spark, d):
    both = table(spark, d, "intervals").select("contig").unionByName(_q(spark, d).select("contig"))
    return both.groupBy("contig").agg(F.count("*").alias("n"))


# Data-processing problems

_ALL = "(SELECT count(*) FROM intervals)"


@_query(
    f"""SELECT 'name' AS key_kind, contig AS key_text FROM intervals WHERE contig IS NOT NULL GROUP BY contig HAVING count(*) >= 0.03::double * {_ALL}
UNION ALL SELECT 'nr', ds_idx::varchar FROM intervals WHERE ds_idx IS NOT NULL GROUP BY ds_idx HAVING count(*) >= 0.03::double * {_ALL}"""
)
def p2_found(spark, d):
    return skew.heavy_keys(table(spark, d, "intervals")).select("key_kind", "key_text")


_VALID = 'start >= 0 AND start < "end"'


@_query(
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS key_kind, {key} AS key_text, count(*) AS n_rows, count(*) FILTER ({_VALID}) AS n_valid, (sum("end" - start) FILTER ({_VALID}))::bigint AS width,
 min(start) FILTER ({_VALID}) AS min_start, max("end") FILTER ({_VALID}) AS max_end FROM intervals GROUP BY ALL"""
        for kind, key in (("name", "contig"), ("nr", "ds_idx::varchar"))
    )
)
def p2_totals(spark, d):
    return skew.region_totals(table(spark, d, "intervals"))


_RUNS = f"""v AS (SELECT ds_idx, contig, start AS s, "end" AS e FROM intervals WHERE {_VALID}),
m AS (SELECT *, max(e) OVER (PARTITION BY ds_idx, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)"""


@_query(f"WITH {_RUNS} SELECT ds_idx, contig, reach AS gap_start, s AS gap_end FROM m WHERE s > reach")
def p3_found(spark, d):
    return periods.gaps(table(spark, d, "intervals"), ["ds_idx", "contig"])


@_query(
    f"""WITH {_RUNS}, g AS (SELECT *, sum((s > reach OR reach IS NULL)::int) OVER (PARTITION BY ds_idx, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT ds_idx, contig, min(s) AS period_start, max(e) AS period_end FROM g GROUP BY ds_idx, contig, g"""
)
def p3_periods(spark, d):
    return periods.periods(table(spark, d, "intervals"), ["ds_idx", "contig"])


@_query(f"WITH {_RUNS} SELECT ds_idx, contig, reach AS gap_start, s AS gap_end FROM m WHERE s > reach")
def gaps_by_blocks(spark, d):
    """The way of entities above ``hot_rows``, taken here by all of more than a few rows."""
    return periods.gaps(table(spark, d, "intervals"), ["ds_idx", "contig"], hot_rows=5)


@_query(
    f"""WITH {_RUNS}, g AS (SELECT *, sum((s > reach OR reach IS NULL)::int) OVER (PARTITION BY ds_idx, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT ds_idx, contig, min(s) AS period_start, max(e) AS period_end FROM g GROUP BY ds_idx, contig, g"""
)
def periods_by_blocks(spark, d):
    return periods.periods(table(spark, d, "intervals"), ["ds_idx", "contig"], hot_rows=5)


_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t]*)'
_LINES_SQL = rf"""t AS (SELECT line_id, regexp_replace(line, '\r\z', '') AS x FROM bed_lines),
l AS (SELECT *, regexp_full_match(x, '(?s){_FIELD}(?:\t{_FIELD})*') AS quoted FROM t
 WHERE regexp_replace(x, '[ \t]', '', 'g') <> '' AND NOT (starts_with(x, '#') OR starts_with(x, 'track ') OR starts_with(x, 'browser '))),
f AS (SELECT *, CASE WHEN quoted THEN [CASE WHEN y[2:2] = '"' THEN replace(y[3:-2], '""', '"') ELSE y[2:] END FOR y IN regexp_extract_all(chr(9) || x, '(?s)\t{_FIELD}')] END AS f FROM l),
n AS (SELECT *, len(f) AS n, CASE WHEN regexp_full_match(f[2], '[0-9]+') THEN coalesce(TRY_CAST(f[2] AS BIGINT), 9999999999) END AS s,
 CASE WHEN regexp_full_match(f[3], '[0-9]+') THEN coalesce(TRY_CAST(f[3] AS BIGINT), 9999999999) END AS e,
 CASE WHEN regexp_full_match(f[5], '-?[0-9]+') THEN TRY_CAST(f[5] AS INT) END AS v FROM f),
c AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 5 THEN 'columns' WHEN NOT starts_with(f[1], 'chr') OR length(f[1]) >= 40 THEN 'contig'
 WHEN s IS NULL OR e IS NULL OR s > 2147483647 OR e > 2147483647 OR e = 0 OR s > e THEN 'coordinate' WHEN f[5] NOT IN ('', '.') AND v IS NULL THEN 'value' END AS reason FROM n)"""


@_query(f"WITH {_LINES_SQL} SELECT line_id, reason FROM c WHERE reason IS NOT NULL")
def p4_found(spark, d):
    return faulty.split_lines(table(spark, d, "bed_lines"))[1].select("line_id", "reason")


@_query(f"WITH {_LINES_SQL} SELECT line_id, f[1] AS contig, s AS start, e AS \"end\", f[4] AS dataset, v AS value FROM c WHERE reason IS NULL")
def p4_rows(spark, d):
    return faulty.split_lines(table(spark, d, "bed_lines"))[0].select("line_id", "contig", "start", "end", "dataset", "value")


@_query(
    f"""WITH {_LINES_SQL} SELECT file, count(*) AS n_lines, count(*) FILTER (n IS NOT NULL AND reason IS NULL) AS n_rows, count(reason) AS n_faults
FROM bed_lines LEFT JOIN c USING (line_id) GROUP BY 1""".replace("n IS NOT NULL AND reason IS NULL", "c.quoted AND reason IS NULL")
)
def p4_files(spark, d):
    return faulty.faults_per_file(table(spark, d, "bed_lines"))


__all__ = ["QUERIES", "SQL", "lenient_int", "table"]
