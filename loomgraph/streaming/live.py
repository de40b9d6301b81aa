"""Incremental queries: Z-sets, live results over changes, and event-time windows.

A Z-set is a DataFrame with a weight column ``_w``; its rows stand for signed
multiplicities.  Linear operators (filter, project, union) act on rows and keep
weights; a join's delta is the sum of three joins of old and new; counts and
sums are signed sums.  What is not incremental (MIN, MAX, outer joins) is
recomputed and compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "_w"


def zset(df: DataFrame) -> DataFrame:
    return df.withColumn(W, F.lit(1).cast("long"))


def _columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def consolidate(z: DataFrame) -> DataFrame:
    """Each row once, without those of weight 0."""
    return z.groupBy(*_columns(z)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(plus(a, negate(b)))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta between two bags."""
    return minus(zset(after), zset(before))


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Weights multiply."""
    right = b.withColumnRenamed(W, "_v")
    return a.join(right, on).withColumn(W, F.col(W) * F.col("_v")).drop("_v")


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of a join whose inputs change: da with b, a with db, da with db."""
    return consolidate(plus(plus(join(da, b, on), join(a, db, on)), join(da, db, on)))


def distinct_delta(z: DataFrame, dz: DataFrame) -> DataFrame:
    """The change of the set of rows with positive weight; only touched rows are looked at."""
    cols = _columns(z)
    touched = dz.select(*cols).distinct()
    on = F.lit(True)
    for c in cols:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    old = z.alias("a").join(touched.alias("b"), on, "left_semi")
    both = plus(old.withColumn("_n", F.lit(0).cast("long")).withColumnRenamed(W, "_o").withColumn(W, F.col("_o")), dz.withColumn("_o", F.lit(0).cast("long")).withColumn("_n", F.col(W)))
    g = both.groupBy(*cols).agg(F.sum("_o").alias("o"), F.sum(F.col("_o") + F.col("_n")).alias("n"))
    return g.withColumn(W, ((F.col("n") > 0).cast("long") - (F.col("o") > 0).cast("long"))).where(F.col(W) != 0).select(*cols, W)


def aggregate(z: DataFrame, keys: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """(keys, n, sums): retractable counts and sums; a group of no rows is gone."""
    cols = [F.sum(F.col(W) * (F.col(c) if isinstance(c, str) else c)).alias(name) for name, c in sums.items()]
    return z.groupBy(*keys).agg(F.sum(W).alias("n"), *cols).where("n != 0")


def aggregate_delta(state: DataFrame, dz: DataFrame, keys: list[str], sums: dict[str, Column | str]) -> tuple[DataFrame, DataFrame]:
    """(new state, delta of its rows): old groups are retracted, new ones inserted."""
    change = dz.groupBy(*keys).agg(F.sum(W).alias("n"), *[F.sum(F.col(W) * (F.col(c) if isinstance(c, str) else c)).alias(name) for name, c in sums.items()])
    new = state.unionByName(change).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).where("n != 0")
    return new, diff(state, new)


class LiveQuery:
    """A query's result that follows commits: the first event is the result, then come deltas.

    ``query`` maps a version number to a DataFrame.  ``touched`` says whether any
    change between two versions concerns the query; untouched versions cost a
    check of predicates and no query.
    """

    def __init__(self, query: Callable[[int], DataFrame], touched: Callable[[int], bool] | None = None):
        self.query, self.touched, self.at, self.last = query, touched, None, None

    def advance(self, to: int) -> DataFrame | None:
        """The event that leads to a version; None if nothing that the query reads has changed."""
        if self.at is not None and (to == self.at or self.touched is not None and not self.touched(self.at)):
            self.at = to
            return None
        now = self.query(to)
        event = zset(now) if self.last is None else diff(self.last, now)
        self.at, self.last = to, now
        return event


def live(dataset, text: str) -> LiveQuery:
    """A live query of a ``Dataset``."""
    return LiveQuery(lambda seq: dataset.query(text, at=seq), lambda after: dataset.touches(text, after))


def follow(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``update(batch, id)`` on each micro-batch of a stream of changes; the checkpoint resumes it."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- event time


def _marked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, which needs instants."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Grouped by tumbling or sliding windows; with ``late`` a watermark drops state (streams)."""
    df = _marked(df, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(window.alias("w"), *keys).agg(*aggregates).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Grouped by sessions: runs of events of a key less than ``gap`` apart."""
    df = _marked(df, time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time."""
    a = left.select("*", F.lit(1).alias("_side"))
    b = right.select(key, time, F.struct(*columns).alias("_r"), F.lit(0).alias("_side"))
    from pyspark.sql import Window

    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return filled.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in columns])
