"""Named datasets: a name stands for a parquet path, and an unknown name is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Datasets:
    """A registry of names and paths, also offered as temporary views."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, dict(paths)

    def load(self, name: str) -> DataFrame:
        """The table of a name."""
        if name not in self.paths:
            raise KeyError(f"{name}: not one of {sorted(self.paths)}")
        return self.spark.read.parquet(self.paths[name])

    def views(self) -> None:
        """Register every table under its name."""
        for name in self.paths:
            self.load(name).createOrReplaceTempView(name)

    def head(self, name: str, n: int, *order: str) -> DataFrame:
        """The first ``n`` rows in an explicit order."""
        return self.load(name).orderBy(*[F.col(c) for c in order]).limit(n)
