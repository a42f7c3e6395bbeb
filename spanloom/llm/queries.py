"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tiling import DEFAULT_BIN, div
from spanloom.llm import leakage, mixture, overlapjoin, quantiles, stuffing
from spanloom.shared import written

QUERIES = {}
SQL = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _valid(spark, d):
    return _table(spark, d, "intervals").where("start >= 0 AND start < end")


# 1: similar tile sets


def tile_rows(spark: SparkSession, d: str) -> DataFrame:
    tiles = F.sequence(div(F.col("start"), DEFAULT_BIN), div(F.col("end") - 1, DEFAULT_BIN))
    return _valid(spark, d).select("ds_idx", "contig", F.explode(tiles).alias("tile"))


_SETS = """tok AS (SELECT DISTINCT ds_idx, contig, unnest(range(start // 16384, ("end" - 1) // 16384 + 1)) AS t FROM intervals WHERE start >= 0 AND start < "end"),
sz AS (SELECT ds_idx, count(*) AS n FROM tok GROUP BY 1),
common AS (SELECT x.ds_idx AS ds_a, y.ds_idx AS ds_b, count(*) AS o FROM tok AS x JOIN tok AS y USING (contig, t) WHERE x.ds_idx < y.ds_idx GROUP BY 1, 2),
found AS (SELECT ds_a, ds_b FROM common JOIN sz AS a ON a.ds_idx = ds_a JOIN sz AS b ON b.ds_idx = ds_b WHERE o / (a.n + b.n - o) >= 0.7)"""


@_query(f"WITH {_SETS} SELECT ds_a, ds_b FROM found")
def p1_found(spark, d):
    pairs, members = overlapjoin.similar_sets(tile_rows(spark, d), "ds_idx", ["contig", "tile"], 0.7)
    return overlapjoin.expanded(pairs, members).select(F.col("a").alias("ds_a"), F.col("b").alias("ds_b"))


@_query(
    f"""WITH {_SETS}, both_ways AS (SELECT ds_a AS ds_idx FROM found UNION ALL SELECT ds_b FROM found),
l AS (SELECT ds_idx, count(*) AS n FROM both_ways GROUP BY 1),
c AS (SELECT ds_idx, list_sort(list((contig, t))) AS s FROM tok GROUP BY 1)
SELECT ds_idx, min(ds_idx) OVER (PARTITION BY s) AS class_id, coalesce(l.n, 0) AS n_links FROM c LEFT JOIN l USING (ds_idx)"""
)
def p1_links(spark, d):
    pairs, members = overlapjoin.similar_sets(tile_rows(spark, d), "ds_idx", ["contig", "tile"], 0.7)
    return overlapjoin.links(pairs, members).withColumnRenamed("sid", "ds_idx")


# 5: percentiles of widths


def _widths(spark, d):
    return _valid(spark, d).select("ds_idx", "batch", (F.col("end") - F.col("start")).alias("width"))


_W = """w AS (SELECT ds_idx, batch, "end" - start AS width FROM intervals WHERE start >= 0 AND start < "end")"""


@_query(
    f"""WITH {_W}, b AS (SELECT ds_idx, batch, median(width) AS m, count(*) AS n FROM w WHERE batch IS NOT NULL GROUP BY 1, 2), g AS (SELECT ds_idx, median(width) AS gm FROM w GROUP BY 1)
SELECT ds_idx, batch FROM b JOIN g USING (ds_idx) WHERE n >= 40 AND (m >= 2 * gm OR 2 * m <= gm)"""
)
def p5_found(spark, d):
    rows = _widths(spark, d)
    summary = written(quantiles.summarise(rows, ["ds_idx", "batch"], "width", 0.1), "widths")
    return quantiles.shifted_batches(rows, "ds_idx", "batch", "width", summary)


@_query()
def p5_widths(spark, d):
    """Median, 90th and 99th percentile of each dataset from its batches' summaries, with their bounds."""
    summary = quantiles.summarise(_widths(spark, d), ["ds_idx", "batch"], "width")
    return quantiles.quantiles(quantiles.combine(summary, ["ds_idx"], 0.001), ["ds_idx"], [0.5, 0.9, 0.99])


@_query("SELECT assay, count(avg_size) AS n, median(avg_size) AS median FROM datasets GROUP BY 1 HAVING count(avg_size) > 0")
def p5_sizes(spark, d):
    """Medians of the catalogue's mean sizes per assay: exact, since the bounds are closed by an exact check."""
    rows = _table(spark, d, "datasets").select("assay", "avg_size")
    summary = written(quantiles.summarise(rows, ["assay"], "avg_size"), "sizes")
    return quantiles.closed_medians(rows, ["assay"], "avg_size", summary)


@_query(f"WITH {_W} SELECT ds_idx, batch, count(*) AS n, median(width) AS median FROM w GROUP BY 1, 2")
def p5_medians(spark, d):
    """Median width of every dataset and batch."""
    rows = _widths(spark, d)
    return quantiles.closed_medians(rows, ["ds_idx", "batch"], "width", written(quantiles.summarise(rows, ["ds_idx", "batch"], "width", 0.05), "widths"))


_PLACES = [0.01, 0.25, 0.5, 0.9, 0.99]
_P = ", ".join(f"({i}, {p})" for i, p in enumerate(_PLACES))


@_query(f"WITH {_W}, o AS (SELECT ds_idx, width, row_number() OVER (PARTITION BY ds_idx ORDER BY width) AS r, count(*) OVER (PARTITION BY ds_idx) AS n FROM w), p(i, p) AS (VALUES {_P}) SELECT ds_idx, i, n, width::double AS value FROM o JOIN p ON r = greatest(1, ceil(n * p - 1e-9))")
def p5_quantiles(spark, d):
    """Five percentiles of each dataset: batches summarised within 2 % of their rows, combined, closed between the bounds."""
    rows = _widths(spark, d)
    summary = written(quantiles.combine(quantiles.summarise(rows, ["ds_idx", "batch"], "width", 0.02), ["ds_idx"], 0.02), "widths")
    return quantiles.closed_quantiles(rows, ["ds_idx"], "width", summary, _PLACES)


@_query("SELECT contig, count(*) AS n, 5 AS n_covered, true AS error_kept, true AS tuples_kept FROM intervals WHERE start >= 0 AND start < \"end\" GROUP BY 1")
def p5_bounds(spark, d):
    """Whether the summaries of contigs keep what they promise: every true rank's value within the bounds, the stated error, and at
    most 400 tuples, however many rows: a fixed part of a large group, all of a small one."""
    rows = _valid(spark, d).select("contig", (F.col("end") - F.col("start")).alias("width"))
    summary = written(quantiles.summarise(rows, ["contig"], "width", 0.01), "contigs")
    c = quantiles.covered(rows, ["contig"], "width", summary, _PLACES)
    return c.select("contig", "n", "n_covered", (F.col("rank_error") <= 0.01 * F.col("n") + 1).alias("error_kept"), (F.col("n_tuples") <= 400).alias("tuples_kept"))


# 6: leaked test items

_GRAMS = r"""lines AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
spoken AS (SELECT doc_id, string_agg(regexp_replace(l, '<[^>]*>|\{[^}]*\}', ' ', 'g'), chr(10) ORDER BY i) AS t FROM lines WHERE NOT regexp_full_match(l, '\s*[0-9]+\s*') AND NOT contains(l, '-->') GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM spoken),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) AS u(k)),
ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM iw, unnest(range(1, len(w) - 10)) AS u(k))"""


@_query(f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)")
def p6_found(spark, d):
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


@_query()
def p6_paraphrases(spark, d):
    return leakage.paraphrases(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


# 7: mixtures


_REACH = """WITH s AS (SELECT source, sum(len(regexp_extract_all(text, '\\S+'))) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM s),
r AS (SELECT m.source, m.max_repeats, coalesce(n, 0) AS n, weight * total <= max_repeats * coalesce(n, 0) AS reachable FROM mix_targets AS m CROSS JOIN t LEFT JOIN s ON s.source = m.source)"""


@_query(f"{_REACH} SELECT source FROM r WHERE NOT reachable")
def p7_found(spark, d):
    sources, _ = mixture.plan(mixture.token_sizes(_table(spark, d, "documents")), _table(spark, d, "mix_targets"))
    return sources.where("NOT reachable").select("source")


def _mixed(spark, d):
    sizes = mixture.token_sizes(_table(spark, d, "documents"))
    sources, rates = mixture.plan(sizes, _table(spark, d, "mix_targets"))
    return mixture.chosen(sizes, rates), sources, rates, sizes


@_query()
def p7_documents(spark, d):
    return _mixed(spark, d)[0]


@_query()
def p7_shares(spark, d):
    return mixture.shares(*_mixed(spark, d)[:2])


@_query(f"{_REACH} SELECT source, reachable, 0::BIGINT AS n_over, 0::BIGINT AS n_repeated, true AS in_bound FROM r")
def p7_promises(spark, d):
    """What must hold of any mixture: repeats within their caps, one row a document, tokens within the draw's bound of the fit."""
    return mixture.kept_promises(*_mixed(spark, d))


@_query("SELECT d.doc_id, d.source FROM documents AS d JOIN mix_targets AS m USING (source) WHERE len(text) > 0 AND max_repeats > 0")
def p7_eligible(spark, d):
    """Documents that may be used: those of stated sources whose rate is above 0."""
    _, _, rates, sizes = _mixed(spark, d)
    return sizes.where("n_tokens > 0").join(rates.where("rate > 0"), ["source", "lang", "topic"]).select("doc_id", "source")


# 8: stuffed pages


# Planted pages are stuffed in most of their cues, others in few, so here one plain look at each cue tells them apart.
@_query(
    r"""WITH t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
c AS (SELECT doc_id, unnest(string_split_regex(x, '(?m)^[^\n]*-->[^\n]*$')[2:]) AS b FROM t),
b AS (SELECT doc_id, trim(regexp_replace(b, '\n[ \t]*[0-9]*\s*$', ''), ' ' || chr(10) || chr(9)) AS b, trim(regexp_replace(regexp_replace(b, '\n[ \t]*[0-9]*\s*$', ''), '<[^>\n]*>|\{[^}\n]*\}', ' ', 'g'), ' ' || chr(10) || chr(9)) AS p FROM c),
w AS (SELECT *, regexp_extract_all(lower(p), '[\p{L}\p{N}]+') AS w, NOT regexp_matches(p, '([^\p{L}\p{N}]|ª)\s*$') AS unended FROM b),
f AS (SELECT doc_id, regexp_matches(b, '(?i)https?://|\bwww\.|\(dot\)|[\p{L}\p{N}]\.(com|net|org|info|test|example|invalid)\b') OR regexp_matches(p, '(^|\s)#[\p{L}\p{N}?]') OR regexp_matches(p, '[\p{L}\p{N}]\*[\p{L}\p{N}]| \| |!!!|;.*;')
 OR unended AND len(w) > 2 AND (len(p) - len(replace(p, ',', '')) >= 2 OR len(w) >= 4 AND len(list_distinct(w)) <= 0.8 * len(w)) AS stuffed FROM w)
SELECT doc_id FROM f GROUP BY 1 HAVING avg(stuffed::int) > 0.5"""
)
def p8_found(spark, d):
    return stuffing.stuffed_pages(_table(spark, d, "documents"))


@_query()
def p8_scores(spark, d):
    return stuffing.scores(_table(spark, d, "documents"))
