"""Encoding pairs as they arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import encode


def encode_stream(encodings: DataFrame, images: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the codes of each micro-batch of ``encodings`` to Parquet at ``path``.

    A batch that is repeated after a failure replaces its own folder, so every
    code stands once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        encode(batch, images, **options).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return encodings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
