"""Rows that fail to parse: load the valid lines typed, give each faulty one its reason.

The lines are read permissively under an explicit schema, corrupt lines keeping their raw text. A line that the reader took
whole and whose text is plain (no quotes, plain digits) is a row. All others are classified again from the raw text: by
quoting, by the number of fields and by casts, in this order. All of it is column expressions in one pass without a shuffle,
so it makes no difference which files hold most of the faulty lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "contig STRING, start INT, end INT, dataset STRING, value INT, _corrupt STRING"
#: Fixed values of the format.
FIELDS = 5
INT_MAX = 2147483647
INT_MIN = -2147483648
IGNORED = ("#", "track ", "browser ")

# More fields than this aren't offered to the reader, which would give up on thousands; they can't be right anyway.
_READER_FIELDS = 64
_PLAIN = r'\Achr[^\t"\r\n]*\t[0-9]+\t[0-9]+\t[^\t"\r\n]*\t(?:-?[0-9]+)?\z'


def _tokens(text: Column) -> Column:
    """Struct(open, bad, n, fields) of a line that may hold quotes: a fold over the pieces between tabs.

    Only the first five fields' values are kept, so a line of a million tabs costs no more than its length.
    """
    zero = F.struct(F.lit(False).alias("open"), F.lit(False).alias("bad"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("fields"), F.lit("").alias("held"))

    def ended(body: Column, prefix: str) -> list[Column]:
        # Doubled quotes pair up from the left within a run, so what remains in the pieces between them are single quotes. A field
        # is closed where the first of these is the last character.
        pieces = F.split(body, '""', -1)
        single = F.exists(pieces, lambda p: p.contains('"'))
        last = F.element_at(pieces, -1)
        closed = ~F.exists(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: p.contains('"')) & (F.instr(last, '"') == F.length(last))
        inside = F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit('"'), F.lit(""))), '"')
        return [(~single).alias(f"{prefix}_open"), (single & ~closed).alias(f"{prefix}_bad"), inside.alias(f"{prefix}_text")]

    def both(piece: Column) -> Column:
        """What a piece means where a quoted field is open before it (c), and where not (s)."""
        quoted = piece.startswith('"')
        fresh = ended(F.substring(piece, 2, INT_MAX), "q")
        q_open, q_bad, q_text = fresh
        return F.struct(
            *ended(piece, "c"),
            (quoted & q_open).alias("s_open"),
            F.when(quoted, q_bad).otherwise(piece.contains('"')).alias("s_bad"),
            F.when(quoted, q_text).otherwise(piece).alias("s_text"),
        )

    def step(acc: Column, x: Column) -> Column:
        pick = lambda name: F.when(acc["open"], x[f"c_{name}"]).otherwise(x[f"s_{name}"])
        value = F.when(acc["open"], F.concat(acc["held"], F.lit("\t"), x["c_text"])).otherwise(x["s_text"])
        keep = acc["n"] < FIELDS
        return F.struct(
            pick("open").alias("open"),
            (acc["bad"] | pick("bad")).alias("bad"),
            (acc["n"] + F.when(pick("open"), 0).otherwise(1)).alias("n"),
            F.when(~pick("open") & keep, F.array_append(acc["fields"], value)).otherwise(acc["fields"]).alias("fields"),
            F.when(pick("open") & keep, value).otherwise("").alias("held"),
        )

    return F.aggregate(F.transform(F.split(text, "\t", -1), both), zero, step)


def _within(digits: Column, limit: int) -> Column:
    """Whether a string of digits is at most ``limit``, however long it is."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return (F.length(short) <= 10) & (F.coalesce(F.when(F.length(short) <= 10, short).try_cast("long"), F.lit(limit + 1)) <= limit)


def classified(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines with ``kind`` ('row', 'fault', 'ignored'), ``reason`` of the faults and the fields of the rows in ``parsed``.

    Reasons: quoting, columns, contig, coordinate, value; the first that applies. One trailing carriage return isn't part of
    a line. A null line, one of only spaces and tabs, a comment and a header are 'ignored'. Rows keep a null value where it
    is empty or a dot. Repeated lines are classified each. Columns named kind, reason or parsed are replaced.
    """
    raw = F.col(f"`{line}`")
    text = F.regexp_replace(raw, r"\r\z", "")
    df = lines.drop("kind", "reason", "parsed").withColumn("__text", text)
    t = F.col("__text")
    ignored = t.isNull() | (F.length(F.translate(t, " \t", "")) == 0) | t.startswith(IGNORED[0]) | t.startswith(IGNORED[1]) | t.startswith(IGNORED[2])
    n_tabs = F.length(t) - F.length(F.translate(t, "\t", ""))
    offered = F.when(~ignored & (n_tabs < _READER_FIELDS), t)
    options = {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    read = F.from_csv(offered, F.lit(SCHEMA), options)
    df = df.withColumn("__ignored", ignored).withColumn("__read", read)
    r = F.col("__read")
    whole = F.coalesce(r["_corrupt"].isNull() & t.rlike(_PLAIN) & (F.length(r["contig"]) < 40) & (r["end"] > 0) & (r["start"] <= r["end"]), F.lit(False))
    df = df.withColumn("__whole", whole)
    has_quote = t.contains('"')
    plain = F.split(t, "\t", FIELDS + 1)
    no_quote = F.struct(F.lit(False).alias("open"), F.lit(False).alias("bad"), (n_tabs + 1).alias("n"), F.slice(plain, 1, FIELDS).alias("fields"), F.lit("").alias("held"))
    again = ~F.col("__ignored") & ~F.col("__whole")
    df = df.withColumn("__tok", F.when(again & has_quote, _tokens(t)).when(again, no_quote))
    k = F.col("__tok")
    f = [F.get(k["fields"], F.lit(i)) for i in range(FIELDS)]
    digits = r"\A[0-9]+\z"
    starts, ends = F.when(f[1].rlike(digits) & _within(f[1], INT_MAX), f[1]).try_cast("long"), F.when(f[2].rlike(digits) & _within(f[2], INT_MAX), f[2]).try_cast("long")
    unsigned = F.regexp_replace(f[4], r"\A-", "")
    number = f[4].rlike(r"\A-?[0-9]+\z") & F.when(f[4].startswith("-"), _within(unsigned, -INT_MIN)).otherwise(_within(unsigned, INT_MAX))
    reason = (
        F.when(k.isNull(), F.lit(None).cast("string"))
        .when(k["open"] | k["bad"], "quoting")
        .when(k["n"] != FIELDS, "columns")
        .when(~f[0].startswith("chr") | (F.length(f[0]) >= 40), "contig")
        .when(starts.isNull() | ends.isNull() | (ends == 0) | (starts > ends), "coordinate")
        .when(~((f[4] == "") | (f[4] == ".") | number), "value")
    )
    df = df.withColumn("reason", reason)
    fields = F.when(
        F.col("__whole"),
        F.struct(r["contig"].alias("contig"), r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"), F.coalesce(r["dataset"], F.lit("")).alias("dataset"), r["value"].alias("value")),
    ).when(
        k.isNotNull() & F.col("reason").isNull(),
        F.struct(f[0].alias("contig"), starts.alias("start"), ends.alias("end"), f[3].alias("dataset"), F.when(number, f[4]).try_cast("int").alias("value")),
    )
    kind = F.when(F.col("__ignored"), "ignored").when(F.col("reason").isNull(), "row").otherwise("fault")
    # The generator keeps filters on its columns from being pushed into, and so evaluated apart from, all that precedes.
    out = F.array(F.struct(kind.alias("kind"), F.col("reason"), fields.alias("parsed")))
    return df.select(*(f"`{c}`" for c in lines.columns if c not in ("kind", "reason", "parsed")), F.inline(out))


def split_lines(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(typed rows, faults): rows with the input's other columns and contig, start, end, dataset, value; faults with the raw line and its reason."""
    both = classified(lines, line)
    fields = ["contig", "start", "end", "dataset", "value"]
    others = [f"`{c}`" for c in lines.columns if c not in (line, "kind", "reason", "parsed", *fields)]
    rows = both.where("kind = 'row'").select(*others, *(F.col("parsed")[c].alias(c) for c in fields))
    return rows, both.where("kind = 'fault'").drop("kind", "parsed")


def faults_per_file(lines: DataFrame, line: str = "line", file: str = "file") -> DataFrame:
    """(file, n_lines, n_rows, n_faults) of each file, combined before the shuffle."""
    both = classified(lines, line)
    return both.groupBy(file).agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "row").alias("n_rows"), F.count_if(F.col("kind") == "fault").alias("n_faults"))
