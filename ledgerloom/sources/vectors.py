"""Generations of a vector table: written beside the one in use, then put in its place by one appended row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATION = "generation long, model string, dimension int, rows long"


class VectorTable:
    """Vectors below ``path``. Readers see the last generation whose descriptor is there, never a part of one.

    A generation's rows are written first; its descriptor is appended when all of them are valid, by a job that either
    commits its file or does not. A writer that fails leaves rows that no descriptor names.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, generation: int, model: str, dimension: int) -> None:
        """``rows(id, vector)``, the last of equal ids by ``at`` if there is such a column. Vectors of another size are an error."""
        if "at" in rows.columns:
            rows = rows.groupBy("id").agg(F.max_by("vector", "at").alias("vector"))
        at = f"{self.path}/rows/{generation}"
        rows.select("id", "vector").write.parquet(at)
        n, bad = self.spark.read.parquet(at).agg(F.count("*"), F.count_if(F.coalesce(F.size("vector") != dimension, F.lit(True)))).first()
        if bad:
            raise ValueError(f"{bad} vectors are not of {dimension} numbers")
        self.spark.createDataFrame([(generation, model, dimension, n)], GENERATION).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def current(self) -> tuple[int, str, int, int]:
        """The descriptor in use: the largest generation that was committed."""
        return tuple(self.spark.read.schema(GENERATION).parquet(f"{self.path}/generations").orderBy(F.desc("generation")).first())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/{self.current()[0]}")
