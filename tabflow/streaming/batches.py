"""Micro-batches as tables: any batch plan over arriving rows, and earlier values of a key across micro-batches.

Each micro-batch is written to a folder of its own number, overwritten if Spark repeats it, so the output holds every row once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabflow.functions.columns import quote
from tabflow.operators.history import HOT_ROWS, Earlier, with_earlier
from tabflow.session import cut_lineage
from tabflow.sources import paths


def stream_batches(
    rows: DataFrame, transform: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """``transform`` gets each micro-batch and its number, and plans anew: tables it reads are listed again each time."""
    if not rows.isStreaming:
        raise ValueError("rows must be a stream")

    def write(batch: DataFrame, number: int) -> None:
        transform(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class KeyedState:
    """Per group, the last row that each of ``values`` took, as a table in versions: one small delta a micro-batch, merged every
    ``merge_every`` of them. Version 0 holds the history before the stream.

    A repeated micro-batch reads the versions before its own and overwrites its own, so it gives the same rows. Rows without a group
    are one group, as in a window.
    """

    def __init__(self, spark: SparkSession, path: str, group: str, order: Sequence[str], values: Mapping[str, Earlier], merge_every: int = 20):
        self.spark, self.path, self.group, self.order, self.values, self.merge_every = spark, path, group, list(order), dict(values), merge_every

    @property
    def _kept(self) -> list[str]:
        return [f"_t{i}" for i in range(len(self.values))]

    def _position(self) -> Column:
        return F.struct(*[F.col(quote(c)) for c in self.order])

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Per value, its order and the value itself (in a struct, since an earlier NULL differs from none), where the row has one."""
        taken = {}
        for t, v in zip(self._kept, self.values.values()):
            entry = F.struct(self._position().alias("o"), F.struct(v.value.alias("v")).alias("s"))
            taken[t] = entry if v.where is None else F.when(v.where, entry)
        return rows.withColumns(taken)

    def _last(self, marked: DataFrame) -> DataFrame:
        return marked.groupBy(quote(self.group)).agg(*[F.max_by(t, F.col(t).getField("o")).alias(t) for t in self._kept])

    def _versions(self, kind: str) -> list[int]:
        """Completely written versions; a short list, since merging removes old ones."""
        names = paths.child_folders(self.spark, f"{self.path}/{kind}")
        numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return [n for n in numbers if paths.exists(self.spark, f"{self._folder(kind, n)}/_SUCCESS")]

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def _parts(self, before: int) -> list[str]:
        base = [v for v in self._versions("merged") if v < before][-1:]
        later = [v for v in self._versions("delta") if v < before and (not base or v > base[0])]
        return [self._folder("merged", v) for v in base] + [self._folder("delta", v) for v in later]

    def prime(self, history: DataFrame) -> None:
        """The state after ``history``, once: a stream that starts again finds it and leaves it."""
        if 0 not in self._versions("merged") and not self._versions("delta"):
            self._last(self._marked(history)).write.mode("overwrite").parquet(self._folder("merged", 0))

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame | None:
        """The state that micro-batch version ``before`` meets, for the groups of ``keys`` only if given; None if there is none."""
        parts = self._parts(before)
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        if keys is not None:
            wanted = keys.select(F.col(quote(self.group)).alias("_wanted")).distinct()
            rows = rows.join(wanted, F.col(quote(self.group)).eqNullSafe(F.col("_wanted")), "left_semi")
        return self._last(rows)

    def follow(self, batch: DataFrame, number: int, late: str = "is_late", hot_rows: int = HOT_ROWS) -> DataFrame:
        """The micro-batch with one column per value, and ``late``; its delta is written.

        Rows of the micro-batch are put in order, whatever order they arrive in. A row before the place where the state last took a
        value is late: what came before it may be forgotten, so it gets the values that are still known to precede it, else NULL.
        """
        version = number + 1
        marked = cut_lineage(self._marked(batch))
        known = self.read(version, marked)
        rows = marked.withColumn("_arrived", F.lit(1))
        if known is not None:
            known = cut_lineage(known)
            for t in self._kept:
                place = [F.col(t).getField("o").getField(c).alias(c) for c in self.order]
                kept = known.filter(F.col(t).isNotNull()).select(quote(self.group), *place, t, F.lit(0).alias("_arrived"))
                rows = rows.unionByName(kept, allowMissingColumns=True)
        self._write(rows, version)
        taken = {n: Earlier(F.col(t).getField("s").getField("v"), F.col(t).isNotNull()) for n, t in zip(self.values, self._kept)}
        # A stored row comes before an arriving one with the same order.
        out = with_earlier(rows, self.group, [*self.order, "_arrived"], taken, hot_rows).filter("_arrived = 1").drop("_arrived", *self._kept)
        if known is None:
            return out.withColumn(late, F.lit(False))
        newest = known.select(F.col(quote(self.group)).alias("_of"), F.array_max(F.array(*[F.col(t).getField("o") for t in self._kept])).alias("_newest"))
        out = out.join(newest, F.col(quote(self.group)).eqNullSafe(F.col("_of")), "left")
        return out.withColumn(late, F.coalesce(self._position() < F.col("_newest"), F.lit(False))).drop("_of", "_newest")

    def _write(self, rows: DataFrame, version: int) -> None:
        self._last(rows).write.mode("overwrite").parquet(self._folder("delta", version))
        if version % self.merge_every:
            return
        bases = [v for v in self._versions("merged") if v < version]
        self.read(version + 1).write.mode("overwrite").parquet(self._folder("merged", version))
        # What this micro-batch itself read stays, should it be repeated.
        for base in bases[-1:]:
            for kind, old in [("merged", [v for v in bases if v < base]), ("delta", [v for v in self._versions("delta") if v <= base])]:
                for v in old:
                    paths.delete(self.spark, self._folder(kind, v))


def stream_earlier(rows: DataFrame, state: KeyedState, path: str, checkpoint: str, late: str = "is_late", hot_rows: int = HOT_ROWS, available_now: bool = True) -> StreamingQuery:
    """Previous and last values of each arriving row's group, over the primed history and all earlier micro-batches."""
    return stream_batches(rows, lambda batch, n: state.follow(batch, n, late, hot_rows), path, checkpoint, available_now)
