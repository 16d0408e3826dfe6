"""Running totals that do not send a whole key to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

RUN_LENGTH = 4096


def running_totals(events: DataFrame, keys: list[str], order: str, values: dict[str, str], run_length: int = RUN_LENGTH) -> DataFrame:
    """Inclusive running sums of ``values`` (output name -> column) per key along an integer ``order`` column.

    Rows are cut into runs of the order column; sums inside a run are a window over (key, run), and the totals of earlier
    runs come from one much smaller table. A key holding most rows is thus spread over its runs.
    """
    cut = events.withColumn("__run", F.floor(F.col(order) / run_length))
    inside = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__run").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in values.items()])
    offsets = totals.select(*keys, "__run", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values])
    local = cut.withColumns({f"__l_{n}": F.sum(c).over(inside) for n, c in values.items()})
    joined = local.join(offsets, [*keys, "__run"])
    return joined.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in values}).select(
        *events.columns, *[n for n in values if n not in events.columns]
    )


def chunk_progress(events: DataFrame) -> DataFrame:
    """Per chunk event: chunks done so far (its index) and the running item total of its document."""
    return running_totals(events, ["document_id"], "chunk_index", {"total_items": "new_items"}).withColumn(
        "done", F.col("chunk_index")
    )
