"""Streams. Frames over a streaming DataFrame support what needs no row order
and no job of its own: projection, filters, arithmetic, casts, scalar functions,
fills by constants and joins with a static frame."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..frame import Frame


def read_stream(spark, path: str, schema, fmt: str = "parquet") -> Frame:
    """A frame over files as they arrive."""
    return Frame(spark.readStream.schema(schema).format(fmt).load(path))


def write_stream(frame: Frame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends what is there now, exactly once, and stops."""
    return frame.to_spark().writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
