"""Finite replays that end: a last row, far ahead in event time, closes what is still open.

A stream emits a window, session or flow once the watermark has passed it, and the watermark follows the newest event;
when the input ends, whatever is younger than the watermark stays in state. A replay knows that its input has ended.
It runs until the table is used up, then writes one closing row to a second source of the same stream and runs once
more from its checkpoint: the watermark passes every real row, and all state is emitted by the operator's own rules.
The closing row's own window, session or flow is the only one left open, so it is never part of the result.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: event time of the closing row; pandas' nanosecond timestamps end in 2262
END = datetime(2200, 1, 1)


class Replay:
    """A replay whose files lie below ``folder``, which every executor must reach. One per run of a stream."""

    def __init__(self, folder: str) -> None:
        self.folder = f"{folder}/replay-{uuid.uuid4().hex}"
        self.closing: DataFrame | None = None

    def source(self, stream: DataFrame, **closing) -> DataFrame:
        """``stream`` with the closing row to come: ``ts`` is ``END``, ``closing`` gives columns the operator needs, the rest is null.

        Watermarks must be set on the result, not on ``stream``: with two of them the lower one would count.
        """
        spark = stream.sparkSession
        values = {"ts": F.lit(END)} | {name: F.lit(value) for name, value in closing.items()}
        unknown = set(values) - set(stream.columns)
        if unknown:
            raise ValueError(f"closing row: no columns {sorted(unknown)}")
        self.closing = spark.range(1).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema))
        ends = f"{self.folder}/end"
        self.closing.limit(0).write.parquet(ends)
        return stream.unionByName(spark.readStream.schema(stream.schema).parquet(ends))

    def drain(self, out: DataFrame) -> DataFrame:
        """Run ``out``, built on ``source``, to the end of its input and past it; the sink, read back."""
        if self.closing is None:
            raise ValueError("give the stream its closing row with source() first")
        self._run(out)
        self.closing.write.mode("append").parquet(f"{self.folder}/end")
        self._run(out)
        return out.sparkSession.read.schema(out.schema).parquet(f"{self.folder}/rows")

    def _run(self, out: DataFrame) -> None:
        run = (out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{self.folder}/state")
               .trigger(availableNow=True).start(f"{self.folder}/rows"))
        run.awaitTermination()
