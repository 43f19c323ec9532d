"""New texts as a stream: each micro-batch's postings are appended once to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings
from ..sources.text import fingerprints


def append_postings(docs: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """docs: a streaming DataFrame of doc_id and text. Exactly once: the file sink's log and the checkpoint agree on batches."""
    return postings(fingerprints(docs)).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
