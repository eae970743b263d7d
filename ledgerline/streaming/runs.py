"""Streams run until their source holds nothing new, into tables that later runs go on with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has given so far: all that its source holds now is processed, appended to a Parquet table under path,
    and the table is read. Offsets, watermarks and state stand in the folder beside it, so another run with the same path
    goes on where this one ended, whatever became of the session in between; a batch that was cut off is done again, and
    its rows come once."""
    done = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")
