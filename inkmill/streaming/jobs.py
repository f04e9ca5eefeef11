"""Streams over growing folders: lazy reads, resumable enrichment, and the record before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmill.plans.lineage import shared_folder


def stream_json(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines as they arrive, ``files_per_batch`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_once(stream: DataFrame, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame], key: str = "id") -> StreamingQuery:
    """All files that are there, through ``change``, added to ``out``; a later call goes on where this one stopped.

    Keys that came before are held in the stream's state, so the output is never read; each micro-batch writes a folder of
    its own (``batch=N``), which a repeated run of that batch replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, group, n) per tumbling window of event time; rows later than ``late`` are dropped by the watermark."""
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), group, "n")


def read_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream gives for the files that are there, as a table in memory; for tests and small reports."""
    mark = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def read_written(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for the files that are there, appended to Parquet files in ``folder`` and read from there.

    The tasks write the rows, the driver holds none of them; each row is there once, also where a batch was run again.
    """
    mark = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", folder).outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


#: Rows of a group that leave its worker at once.
SLICE = 10_000


def shift_quotes_stream(stream: DataFrame, group: str, seq: str, text: str, least: int = 5) -> DataFrame:
    """(group, seq, text): the record-by-record form of the quote repair, with the last kept record of a group as state.

    A record comes out when the next one that is kept arrives; the newest of each group waits in the state. Records of one
    group must arrive in order; within a micro-batch they are sorted, so a group's part of a micro-batch must fit one worker
    (the source's ``maxFilesPerTrigger`` bounds it).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from inkmill.operators.records import REPAIR_QUOTES as quotes

    def step(key, batches, state):
        held = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(seq)
        for at, t in zip(rows[seq], rows[text]):
            if t is None:
                continue
            rest = t
            if held is not None:
                lead, moved = t.lstrip(), ""
                while lead and lead[0] in quotes:
                    moved, lead = moved + lead[0], lead[1:].lstrip()
                if moved:
                    rest, held = lead, (held[0], held[1] + moved)
            if len(rest.strip()) < least:
                continue
            if held is not None:
                out.append((key[0], held[0], held[1]))
            held = (int(at), rest)
            if len(out) == SLICE:
                yield pd.DataFrame(out, columns=[group, seq, text])
                out = []
        if held is not None:
            state.update(held)
        yield pd.DataFrame(out, columns=[group, seq, text])

    return stream.groupBy(group).applyInPandasWithState(step, f"`{group}` string, `{seq}` bigint, `{text}` string", "seq bigint, text string", "append", GroupStateTimeout.NoTimeout)
