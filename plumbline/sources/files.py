"""Files and tables: graph tables, vectors in blobs, folder scans, configuration, templates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from plumbline.functions.text import glob_to_regex
from plumbline.sources.code import EDGE, NODE


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as a whole, replacing what was there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8."""
    return spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges")


def decode_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """A column of little-endian single-precision blobs as arrays; a length that is no multiple of four gives null."""
    import pyarrow as pa

    at = rows.columns.index(column)
    schema = rows.drop(column).schema.add(column, ArrayType(FloatType()))

    def work(batches):
        for batch in batches:
            vectors = [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist() for b in batch.column(at).to_pylist()]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(work, schema).select(*rows.columns)


def encode_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """A column of arrays as little-endian single-precision blobs; null stays null."""
    import pyarrow as pa

    at = rows.columns.index(column)
    schema = rows.drop(column).schema.add(column, "binary")

    def work(batches):
        for batch in batches:
            blobs = [None if v is None else encode_vector(v) for v in batch.column(at).to_pylist()]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary())], names=schema.names)

    return rows.mapInArrow(work, schema).select(*rows.columns)


def encode_vector(values: list[float]) -> bytes:
    """S11."""
    return np.asarray(values, "<f4").tobytes()


def base_name_filter(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """The file's own name fits an inclusion, if there are any, and no exclusion."""
    name = F.substring_index(path, "/", -1)
    test = name.rlike("|".join(map(glob_to_regex, include))) if include else F.lit(True)
    return test & ~name.rlike("|".join(map(glob_to_regex, exclude))) if exclude else test


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, mod_time) of the files below ``root``; contents are not read. Spark's readers pass over empty files and names that begin with ``_`` or ``.``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mod_time"))
    return files.where(base_name_filter(F.col("path"), include, exclude))


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; ``mode``: light (batch), balanced (warm tables), full (streams)."""

    mode: str = "balanced"
    rebuild_seconds: int = 300
    poll_seconds: int = 2
    search_limit: int = 50
    fuzzy_threshold: float = 0.3
    stale_hours: float = 24.0
    stale_action: str = "warn"
    dedup_hours: float = 24.0
    exempt_paths: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.mode not in ("light", "balanced", "full"):
            raise ValueError(f"unknown mode: {self.mode}")

    @property
    def trigger(self) -> dict:
        """How streams are started in this mode."""
        return {"processingTime": f"{self.rebuild_seconds} seconds"} if self.mode == "full" else {"availableNow": True}


def load_config(text: str) -> Config:
    """From JSON, or from lines ``key: value``; unknown keys are an error, absent ones keep their default."""
    try:
        given = json.loads(text) if text.strip() else {}
    except ValueError:
        given = {}
        for line in text.splitlines():
            line = line.split("#")[0].strip()
            if line:
                key, _, value = line.partition(":")
                given[key.strip()] = value.strip().strip("\"'")
    kinds = {f.name: f.default.__class__ for f in fields(Config) if f.name != "exempt_paths"}
    if unknown := set(given) - set(kinds) - {"exempt_paths"}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {k: kinds[k](v) for k, v in given.items() if k in kinds}
    if "exempt_paths" in given:
        raw = given["exempt_paths"]
        values["exempt_paths"] = tuple(raw) if isinstance(raw, list) else tuple(x.strip() for x in raw.strip("[]").split(",") if x.strip())
    return Config(**values)


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the fix templates in a folder that Spark's readers can open; empty files are none."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.ya?ml$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def folders(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers, ascending, of the folders ``<prefix><number>`` below ``root`` that were written to the end."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    at = of(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        path = status.getPath()
        number = path.getName().removeprefix(prefix)
        if path.getName().startswith(prefix) and number.isdigit() and fs.exists(of(path, "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


class StateTable:
    """A small table of states that is replaced as a whole: every save is a new version, the last complete one counts.

    A save that breaks off leaves the version before it in force, as a version is
    complete only once its marker is written.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _versions(self) -> list[int]:
        return folders(self.spark, self.root, "v")

    def load(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{versions[-1]}")

    def save(self, states: DataFrame) -> None:
        versions = self._versions()
        states.write.mode("overwrite").parquet(f"{self.root}/v{(versions[-1] if versions else 0) + 1}")
