"""Registry of the library's own queries: name -> callable(spark, sf_dir), and their DuckDB SQL.

Names begin with the operator's number in the coverage list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import findings, governance, graph, search, sequences, sources, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (graph, findings, text, governance, search, sequences, sources):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)

FLAGSHIP = "g_callees_within_3"
