"""A store of texts with vectors: versions of a Parquet table in a folder, searched by cosine similarity.

Every change writes a new version and leaves the old ones; readers take the newest that is complete, so a job
that is lost halfway changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational

ROWS = "id string, kind string, text string, metadata map<string, string>, vector array<float>"


def score(similarity: Column) -> Column:
    """Cosine distance as a score from 0 to 100, with two digits."""
    distance = F.lit(1.0) - similarity
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - distance / 2) * 100)), 2)


class VectorStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest complete version; 0 where there is none."""
        fs, path = self._fs()
        if not fs.exists(path):
            return 0
        found = [int(m[1]) for s in fs.listStatus(path) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName())) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(found, default=0)

    def rows(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/v{n}") if n else self.spark.createDataFrame([], ROWS)

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{self.version() + 1}")

    def insert(self, new: DataFrame) -> None:
        """Rows are added; rows of an id that is there already take its place."""
        named = [c.split(" ")[0] for c in ROWS.replace("map<string, string>", "map").split(", ")]
        self._write(self.rows().join(new.select("id").distinct(), "id", "left_anti").select(*named).unionByName(new.dropDuplicates(["id"]).select(*named)))

    def delete(self, ids: DataFrame | None = None, kind: str | None = None) -> None:
        """Rows of the ids go, or all of a kind, or, without either, all."""
        rows = self.rows()
        kept = rows.join(ids.select("id"), "id", "left_anti") if ids is not None else rows.filter(F.col("kind") != kind) if kind is not None else rows.limit(0)
        self._write(kept)

    def search(self, queries: DataFrame, k: int, kinds: list[str] | None = None, where: Column | None = None, contains: str | None = None) -> DataFrame:
        """(query, id, kind, score): for each query (id, vector) and each kind the k nearest rows that fit the conditions, best first within a query."""
        rows = self.rows()
        rows = rows.filter(where) if where is not None else rows
        rows = rows.filter(F.contains("text", F.lit(contains))) if contains else rows
        out = None
        for kind in kinds or [r["kind"] for r in rows.select("kind").distinct().orderBy("kind").collect()]:
            near = relational.cosine_topk(queries.select(F.concat(F.lit("q:"), F.col("id")).alias("id"), "vector"), rows.filter(F.col("kind") == kind).select("id", "vector"), k, "id", "vector")
            found = near.select(F.substring("q", 3, 1 << 30).alias("query"), F.col("v").alias("id"), F.lit(kind).alias("kind"), score(F.col("sim")).alias("score"))
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], "query string, id string, kind string, score double")
