"""Gauges, counters and histograms as tables, for whatever exports them.

Every measure is one aggregation that combines before its shuffle; the number of
rows that come out is that of the label values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The upper bounds of the latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    """(labels, n): rows of each combination of labels; null labels count as empty ones."""
    return rows.groupBy(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in labels]).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, *labels: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(labels, le, n): values up to each bound, cumulative, the last bound ``+Inf``; null values count only there."""
    kept = rows.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in labels], F.col(value).alias("_value"))
    counts = [F.count_if(F.col("_value") <= b).alias(f"_{k}") for k, b in enumerate(buckets)]
    wide = kept.groupBy(*labels).agg(*counts, F.count("*").alias("_all"))
    bars = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_{k}").alias("n")) for k, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return wide.select(*labels, F.inline(bars))


def graph_gauges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gauge, value): the sizes of a graph."""
    size = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("gauge"), "value")
    return size(nodes, "graph_nodes_total").unionByName(size(edges, "graph_edges_total"))
