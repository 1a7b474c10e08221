"""Price changes of a stream, in the order of time, however its rows are split into batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State is kept by this store, which value and list states with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt to this many states.  A checkpoint is bound to it.
BUCKETS = 512
_OUT = "key string, id string, price long, observed_at timestamp"
_ROWS = pa.schema([("key", pa.string()), ("id", pa.string()), ("price", pa.int64()), ("at", pa.int64())])


def _packed(rows: pa.Table) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ROWS) as writer:
        writer.write_table(rows)
    return (out.getvalue().to_pybytes(),)


def _unpacked(state: Any) -> pa.Table:
    """The rows of a value or list state."""
    if not state.exists():
        return _ROWS.empty_table()
    held = state.get()
    held = [held] if isinstance(held, tuple) else held
    return pa.concat_tables([_ROWS.empty_table(), *[pa.ipc.open_stream(bytes(x[0])).read_all() for x in held]])


def _let_out(last: pa.Table, due: pa.Table, forget: int | None) -> tuple[pa.Table, pa.Table]:
    """The rows of ``due`` whose price differs from the one before, or follow it after ``forget`` microseconds or more; and the last row of each key.

    ``last`` has the last row of keys so far; what is due is later.
    """
    new = [False] * len(last) + [True] * len(due)
    rows = pa.concat_tables([last, due]).append_column("new", pa.array(new, pa.bool_()))
    rows = rows.sort_by([("key", "ascending"), ("new", "ascending"), ("at", "ascending"), ("id", "ascending")]).combine_chunks()
    if not len(rows):
        return due, last
    codes = np.asarray(pc.rank(rows["key"], tiebreaker="dense"))
    price, none, at = np.asarray(pc.fill_null(rows["price"], 0)), np.asarray(pc.is_null(rows["price"])), np.asarray(rows["at"])
    differs = np.ones(len(rows), bool)
    differs[1:] = (codes[1:] != codes[:-1]) | (price[1:] != price[:-1]) | (none[1:] != none[:-1])
    if forget:
        differs[1:] |= at[1:] - at[:-1] >= forget
    ends = np.append(codes[1:] != codes[:-1], True)
    kept = rows.drop_columns("new")
    return kept.filter(pa.array(differs & np.asarray(rows["new"]))), kept.filter(pa.array(ends))


class Changes(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then lets those out whose price differs from the key's one before.

    A state is that of all keys of a bucket, as Arrow tables: their latest rows and the rows
    that wait.  A row that follows its key's one before after ``forget_ms`` or more is new,
    and so is what comes after the key was forgotten for that.
    """

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(frame[_ROWS.names], _ROWS, preserve_index=False) for frame in rows]
        self.waiting.appendList([_packed(pa.concat_tables(new).combine_chunks())])
        self._wake(min(pc.min(t["at"]).as_py() for t in new if len(t)))
        yield pd.DataFrame()

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # rows up to the watermark are due; what comes later and is not newer is left out
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(self.waiting)
        passed = pc.less_equal(rows["at"], until)
        due, left = rows.filter(passed), rows.filter(pc.invert(passed))
        forget = self.forget_ms * 1000 if self.forget_ms else None
        out, last = _let_out(_unpacked(self.last), due, forget)
        if forget:
            last = last.filter(pc.greater(last["at"], until - forget))
        self.last.update(_packed(last)) if len(last) else self.last.clear()
        if len(due):
            self.waiting.put([_packed(left)]) if len(left) else self.waiting.clear()
        if len(left):
            self._wake(pc.min(left["at"]).as_py())
        if forget and len(last):
            self._wake(pc.min(last["at"]).as_py() + forget)
        found = out.select(["key", "id", "price"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        found["observed_at"] = pd.to_datetime(np.asarray(out["at"]), unit="us")
        yield found

    def close(self) -> None:
        pass


def change_stream(points: DataFrame, late: str, key: str = "deal_id", forget_days: int | None = None) -> DataFrame:
    """(key, id, price, observed_at) of the points whose price differs from the one before, in order of time and id.

    The stream has the columns id, price and observed_at, and the key.  Rows that come up to
    ``late`` behind the latest time count where they belong, later ones are left out.  What is
    not older than the watermark waits, as an earlier row may still come.  Keys share states,
    BUCKETS of them, as a state costs a call for each batch; the waiting rows of one are held
    in its task's memory when their time has come.  Rows without a key or a time are left out.
    """
    session = points.sparkSession
    if session.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {STORE}")
    timed = points.select(F.col(key).cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.col("price").cast("long").alias("price"), F.col("observed_at").cast("timestamp").alias("observed_at"))
    timed = timed.where("key is not null and observed_at is not null").withColumn("at", F.unix_micros("observed_at")).withWatermark("observed_at", late)
    forget = forget_days * 86_400_000 if forget_days else None
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Changes(forget), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def changes_of_files(spark: SparkSession, folder: str, schema: str, out: str, late: str, key: str = "deal_id", forget_days: int | None = None) -> DataFrame:
    """The changes among Parquet files that were not read before, a file a batch, added to ``out``; all that ``out`` has by then."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    changes = change_stream(rows, late, key, forget_days)
    changes.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/changes").awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{out}/changes")
