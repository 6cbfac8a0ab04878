"""The daily resample over a stream."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_sum_stream(stream: DataFrame, ts: str, value: str, late: str = "1 day", name: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """``by, ds, y`` per day; a day is final once the watermark has passed it.

    Days without rows do not appear; ``daily_sum_filled_stream`` has them, too.
    """
    day = F.window(F.col(ts), "1 day")
    summed = stream.withWatermark(ts, late).groupBy(*by, day).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    return summed.select(*by, F.col("window.start").cast("date").alias("ds"), name)


class _Gaps(StatefulProcessor):
    """Passes finished days on in order, with 0 for the days between; remembers the last day of a series."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # by place: the plan may rename its columns
        for day, y in sorted((d, y) for frame in rows for d, y in zip(frame.iloc[:, -2], frame.iloc[:, -1])):
            while last is not None and last + dt.timedelta(days=1) < day:
                last += dt.timedelta(days=1)
                out.append((*key, last, 0.0))
            out.append((*key, day, y))
            last = day
        self.last.update((last,))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def daily_sum_filled_stream(stream: DataFrame, ts: str, value: str, late: str = "1 day", name: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """``by, ds, y`` from the first to the last finished day of a series, every day once and in order, days without rows as 0.

    Days are summed by Spark first, so the stateful step sees one row a day
    and series. Days after a series' latest finished one wait for its next, as a
    series may have ended. Rows later than ``late`` are dropped by the
    watermark. Null keys form a series. The session's state store is set to
    the RocksDB one, which the step needs.
    """
    spark = stream.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    keys = [f"k{i}" for i in range(max(len(by), 1))]
    renamed = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit("").alias(keys[0])]
    days = daily_sum_stream(stream, ts, value, late, "_y", by).select(*renamed, "ds", F.col("_y").cast("double").alias("_y"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in days.schema.fields[: len(keys)]) + ", ds date, y double"
    filled = days.groupBy(*keys).transformWithStateInPandas(_Gaps([*keys, "ds", "y"]), schema, "Append", "None")
    return filled.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "ds", F.col("y").alias(name))
