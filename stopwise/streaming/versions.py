"""Tables that are replaced as a whole: readers see the old version until the new one is complete."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that versions are written to in turn; a reader may go on with a version while so many less one are written.
PLACES = 4


class VersionedTable:
    """Versions of a table under a path, numbered by batch, and a manifest that names those that are complete.

    A version is written to a place of its own; adding its number to the manifest,
    one small file, makes it the current one.  A failure before that leaves the
    version before it in force, and writing a number again that the manifest has
    changes nothing, so a repeated batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> int | None:
        """The number of the current version; None before the first."""
        try:
            return self.spark.read.schema("version long").json(f"{self.path}/manifest").agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def place(self, version: int) -> str:
        return f"{self.path}/place-{version % PLACES}"

    def stage(self, df: DataFrame, version: int) -> None:
        """Write a version without making it the current one."""
        df.write.mode("overwrite").parquet(self.place(version))

    def swap(self, version: int) -> None:
        """Make a staged version the current one."""
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def replace(self, df: DataFrame, version: int) -> bool:
        """Make df the current version; False, and nothing done, where the manifest has the number or a later one."""
        now = self.current()
        if now is not None and version <= now:
            return False
        self.stage(df, version)
        self.swap(version)
        return True

    def read(self) -> DataFrame | None:
        """The current version; None before the first."""
        now = self.current()
        return None if now is None else self.spark.read.parquet(self.place(now))
