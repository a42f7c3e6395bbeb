"""Which physical shape a join should get, where the optimizer can't know it by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast: some MB of query tiles.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it really has at most ``limit`` rows; else unchanged, so that it is shuffled.

    The size is checked by counting no more than ``limit`` + 1 rows, not taken from an estimate. A stream can't be counted
    and is left as it is.
    """
    if df.isStreaming or limit <= 0:
        return df
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """``rows`` with the other columns of ``table`` at equal ``keys``, null keys equal too.

    A table of at most ``limit`` rows, counted first, is broadcast, so rows don't move. A larger one is met under ``salts`` numbers,
    of which each row has one by its content and partition (the same when a task runs again) and the table's rows have all, so a key
    that holds most rows is spread over as many tasks. ``table`` is read more than once and should be stored.
    """
    small = rows.isStreaming or table.limit(limit + 1).count() <= limit
    own = [c for c in table.columns if c not in keys]
    if small:
        left, right, on = rows, F.broadcast(table), keys
    else:
        left = rows.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), *(F.col(f"`{c}`") for c in rows.columns)), F.lit(salts)).cast("int"))
        right, on = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), [*keys, "__salt"]
    met = F.lit(True)
    for k in on:
        met = met & F.col(f"l.`{k}`").eqNullSafe(F.col(f"t.`{k}`"))
    return left.alias("l").join(right.alias("t"), met).select(*(F.col(f"l.`{c}`") for c in rows.columns), *(F.col(f"t.`{c}`") for c in own))


def leaf_tasks(df: DataFrame) -> int:
    """About how many tasks read ``df``, from the optimizer's estimate of its size: nothing is run, nor planned physically."""
    session = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    least = max(1, session.sparkContext.defaultParallelism)
    # A plan whose size nobody knows counts as beyond all bounds.
    return least if size >= 1 << 60 else max(least, -(-size // part))


def pushed_filters(df: DataFrame) -> str:
    """The filters that reach the file scan, as the plan states them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line.partition("PushedFilters:")[2] for line in plan.splitlines() if "PushedFilters:" in line)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x or "Exchange SinglePartition" in x for x in plan.splitlines())
