"""An edit log as a stream: each micro-batch is merged into the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.edits import last_wins


def merge_batch(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State after a batch; late and repeated edits never replace newer ones."""
    both = batch if state is None else state.unionByName(batch)
    return last_wins(both, keys, order).drop("first_seen").select(*batch.columns)


def follow(edits: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Run the merge over all available edits; versions of the state are written below ``path``.

    Every version is complete and named by its batch, so a batch run again
    after a failure writes the same version from the same predecessor.
    """
    schema = edits.schema

    def step(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.schema(schema).parquet(f"{path}/v={n - 1}") if n else None
        merge_batch(old, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v={n}")

    return edits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edit_rate(edits: DataFrame, ts: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Edits per kind and window, with a watermark for late ones (optional extension)."""
    return edits.withWatermark(ts, late).groupBy(F.window(ts, width), "kind").agg(F.count(F.lit(1)).alias("n"))
