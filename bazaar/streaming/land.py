"""Landing of a message stream in the raw zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bazaar.streaming.messages import decodable


def land(messages: DataFrame, root: str, checkpoint: str, rows_per_file: int = 1_000_000) -> StreamingQuery:
    """Write JSON lines to ``root/status=ok/topic=<t>``; values that are no JSON object go to ``status=rejected``.

    Files are compressed, because every line repeats the names of its fields. One task reads a compressed file, so a file holds
    at most ``rows_per_file`` lines.

    Takes what is there and stops. The checkpoint and the sink's log make every message land once: a second run over
    the same input adds nothing, and a run after a crash goes on where the last complete batch ended.
    """
    status = F.when(decodable(), "ok").otherwise("rejected")
    one_line = F.translate("value", "\r\n", "  ")  # between tokens a line break is as good as a blank
    return (
        messages.select(one_line.alias("value"), status.alias("status"), "topic")
        .writeStream.format("text")
        .partitionBy("status", "topic")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "gzip")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(root)
    )


def land_and_wait(messages: DataFrame, root: str, checkpoint: str) -> None:
    land(messages, root, checkpoint).awaitTermination()
