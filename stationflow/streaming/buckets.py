"""Rows of a stream held back until the watermark has passed them, many keys in one state.

Keys are dealt to buckets by hash, and a bucket is what Spark groups by. So a trigger asks Python once per bucket, not once per
key, and a bucket's rows are handled as Arrow columns. What a trigger brings to a bucket is appended to list state, one Arrow
frame for each batch; an event-time timer tells when the watermark has passed the earliest row, and only then the list is read.
State is kept by RocksDB, on the executors' disks and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets a stream's keys are dealt to. A state belongs to its bucket, so the number may not change under a checkpoint.
BUCKETS = 1024
BUCKET = "_bucket"


def use_state_lists(spark: SparkSession) -> None:
    """List state and timers need the RocksDB state store; a provider that the cluster has named stays."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def unpacked(state: tuple) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(state[0]))).read_all()


class Bucket(StatefulProcessor):
    """Rows of a bucket, with their time as ``us``, until the watermark lets ``settle`` hand something out."""

    STATE = "rows binary"

    def __init__(self, row: T.StructType):
        self.row = row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = to_arrow_schema(self.row)
        self.waiting = handle.getListState("waiting", self.STATE)
        self.settled = set()

    def due(self, rows: pa.Table) -> int | None:
        """Time whose passing makes ``settle`` worth while for these rows."""
        return pc.min(rows["us"]).as_py()

    def settle(self, rows: pa.Table, passed: int) -> tuple[list[pa.Table], pa.Table]:
        """What to give out now that all rows up to ``passed`` have come, and the rows that go on waiting."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        dues = []
        for batch in rows:
            came = pa.table([pa.array(batch[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema)
            if came.num_rows:
                self.waiting.appendValue(packed(came))
                dues.append(self.due(came))
        if dues:
            self.settled.discard(key[0])
            self.wake(min(dues))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first of a trigger's timers settles the whole bucket
        if key[0] in self.settled:
            return
        self.settled.add(key[0])
        frames = [unpacked(state) for state in self.waiting.get()]
        rows = pa.concat_tables(frames) if frames else self.schema.empty_table()
        out, rest = self.settle(rows, timerValues.getCurrentWatermarkInMs() * 1000)
        if rest.num_rows:
            if rest.num_rows < rows.num_rows:
                self.waiting.put([packed(rest)])
            self.wake(self.due(rest))
        elif frames:
            self.waiting.clear()
        for table in out:
            if table.num_rows:
                yield table.to_pandas(types_mapper=pd.ArrowDtype)

    def close(self) -> None:
        pass

    def wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)
