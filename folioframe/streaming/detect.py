"""Detection of arriving pages against the template catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from folioframe.operators import retrieval


def stream_detection(
    pages: DataFrame, signatures: Callable[[DataFrame], DataFrame], templates: DataFrame, sink: str, checkpoint: str, k: int = retrieval.TOP_K
):
    """Rank templates for every page of each micro-batch.

    Ranking windows are not allowed on streams, so each batch runs the batch pipeline and writes its own
    folder; a batch repeated after a failure replaces itself.
    """

    def rank(batch: DataFrame, batch_id: int) -> None:
        top = retrieval.ranked_templates(signatures(batch), templates, k)
        top.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(rank).start()
    )
