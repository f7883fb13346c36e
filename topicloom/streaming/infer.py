"""Topics of arriving documents: each micro-batch is folded in against a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from topicloom.plans.lineage import forget
from topicloom.plans.train import Model


def infer_stream(docs: DataFrame, model: Model, path: str, checkpoint: str, iterations: int = 5, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that writes ``doc_id, topic, cnt`` of each batch under ``path``.

    The model's rows are counted once, before the first batch; a replayed batch
    overwrites itself; batches without documents write nothing.  ``trigger`` is handed to Spark.
    """
    model.frozen()

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            got = model.transform(batch, iterations)
            got.write.mode("overwrite").parquet(f"{path}/batch={number}")
            forget(got)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
