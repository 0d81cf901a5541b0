"""Vector search: exact top-N by cosine distance, and two approximate indexes: written cells, and random projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, literal, norm


def nearest(chunks: DataFrame, query: Sequence[float], limit: int, *, id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(chunk_id, score = 1 - distance): the ``limit`` nearest of all non-null vectors; each task keeps its own best first."""
    scored = chunks.where(F.col(vector).isNotNull()).select(F.col(id).alias("chunk_id"), cosine(F.col(vector), literal(query)).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


class LshIndex:
    """Candidates by random projections of unit vectors (euclidean order is then cosine order), ranked exactly."""

    def __init__(self, chunks: DataFrame, *, id: str = "chunk_id", vector: str = "embedding", tables: int = 8, width: float = 0.8, seed: int = 42):
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        unit = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
        self.rows = chunks.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(id).alias("chunk_id"), vector, array_to_vector(unit).alias("unit"))
        self.vector = vector
        self.model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed).fit(self.rows)

    def nearest(self, query: Sequence[float], limit: int) -> DataFrame:
        from pyspark.ml.linalg import Vectors

        length = sum(x * x for x in query) ** 0.5 or 1.0
        near = self.model.approxNearestNeighbors(self.rows, Vectors.dense([x / length for x in query]), limit)
        return near.select("chunk_id", cosine(F.col(self.vector), literal(query)).alias("score")).orderBy(F.desc("score"), "chunk_id")


#: Vectors that the cells' centres are fitted on at most, cells, and cells that a query reads.
SAMPLE, CELLS, PROBES = 20_000, 32, 20


def write_cells(chunks: DataFrame, path: str, *, id: str = "chunk_id", vector: str = "embedding", cells: int = CELLS, seed: int = 42) -> None:
    """Writes all vectors that have a direction, partitioned by the nearest of ``cells`` centres.

    Centres are fitted by k-means on at most SAMPLE unit vectors, those with the least hashes of their id; every vector is
    assigned and written. A cell's vectors are spread over several tasks and files.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
    rows = chunks.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(id).alias("chunk_id"), F.col(vector).alias("embedding"), array_to_vector(unit).alias("unit"))
    some = rows.select("unit", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE)
    model = KMeans(k=cells, featuresCol="unit", predictionCol="cell", seed=seed, maxIter=10).fit(some)
    placed = model.transform(rows).select("chunk_id", "embedding", "cell")
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.partitionBy("cell").mode("overwrite").parquet(path)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    chunks.sparkSession.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/_centres")


class CellIndex:
    """Vectors that :func:`write_cells` wrote: a query reads the cells of its nearest centres only, and ranks them exactly."""

    def __init__(self, spark, path: str):
        self.rows = spark.read.parquet(path)
        self.centres = spark.read.schema("cell int, centre array<double>").json(f"{path}/_centres").collect()  # CELLS rows

    def nearest(self, query: Sequence[float], limit: int, *, probes: int = PROBES) -> DataFrame:
        def closeness(centre) -> float:
            size = sum(x * x for x in centre) ** 0.5 or 1.0
            return sum(x * y for x, y in zip(query, centre)) / size

        chosen = [r["cell"] for r in sorted(self.centres, key=lambda r: (-closeness(r["centre"]), r["cell"]))[:probes]]
        return nearest(self.rows.where(F.col("cell").isin(*chosen)), query, limit)
