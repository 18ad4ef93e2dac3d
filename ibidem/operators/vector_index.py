"""RT7, TK2: a kept vector index of inverted lists, with exact re-ranking.

Centroids are learned by k-means from a sample of about `sample` vectors at most. Every vector is written under its nearest
centroid, in folders by list, which are dealt to files by a salt of the key, so a list that a third of all vectors fall into
is many files. A query is compared with all centroids and then, exactly, with the vectors of its `probes` nearest lists alone:
of all other lists nothing is read. With as many probes as lists a search is exact. The more the vectors cluster, the fewer
lists are enough; vectors without any structure need about half of them for nine in ten of the true neighbours.

Vectors are added and deleted by versions, as in the text index: a newer vector of a key takes the place of older ones.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best import dense_top
from .retrieval import similarity
from .shared import small, written
from .versions import Versions

SAMPLE, MOST_STALE, BLOCK = 100_000, 1_000_000, 500


def centroids(vectors: DataFrame, vector: str, lists: int, sample: int = SAMPLE, seed: int = 42) -> list[list[float]]:
    """The centres of k-means over a sample of about `sample` vectors at most, chosen by their hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    own = vectors.select(F.col(vector).cast("array<double>").alias("_v"))
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("_v"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    held = written(own.select(array_to_vector("_v").alias("features")))
    return [c.tolist() for c in KMeans(k=lists, seed=seed, maxIter=10).fit(held).clusterCenters()]


def nearest_lists(rows: DataFrame, vector: str, centres: list[list[float]], n: int) -> DataFrame:
    """Adds `list`, a row for each of the n centres nearest to a vector; matrix products over batches of rows."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    held = rows.sparkSession.sparkContext.broadcast(centres)  # lists x dimensions

    def work(parts):
        import numpy as np
        import pyarrow as pa

        centre = np.array(held.value)
        half = (centre * centre).sum(axis=1) / 2
        few = min(n, len(centre))
        for part in parts:
            column = part.column(part.schema.get_field_index(vector))
            for k in range(0, len(part), 4096):
                own = column[k : k + 4096]
                found = np.asarray(own.flatten(), np.float64).reshape(len(own), -1) @ centre.T - half
                best = np.argpartition(-found, few - 1, axis=1)[:, :few]
                at = pa.array(np.repeat(np.arange(len(own)), few))
                out = part.slice(k, len(own)).take(at)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(best.ravel().astype(np.int32))], [*out.schema.names, "list"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


class VectorIndex:
    """An index in a folder, over vectors of one key column."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)
        _, rows = self.versions.current()
        facts = json.loads(next((r.facts for r in rows if r.kind == "facts"), "{}"))
        self.metric, self.rows_a_file = facts.get("metric", "l2sq"), facts.get("rows_a_file", 500_000)
        paths = [r.path for r in rows if r.kind == "centres"]
        self.centres = [r["centre"] for r in self.versions.read(paths).orderBy("list").collect()] if paths else []  # `lists` rows

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str, vector: str, lists: int, metric: str = "l2sq", sample: int = SAMPLE, rows_a_file: int = 500_000) -> VectorIndex:
        """Learns the centroids and indexes every vector."""
        spark = vectors.sparkSession
        versions = Versions.create(spark, folder)
        centres = centroids(vectors.where(F.col(vector).isNotNull()), vector, lists, sample)
        path, _ = versions.write(spark.createDataFrame(list(enumerate(centres)), "list int, centre array<double>"), "centres")
        facts = json.dumps({"metric": metric, "rows_a_file": rows_a_file})
        versions.publish(0, [("facts", 0, "", 0, facts), ("centres", 0, path, 0, None)])
        index = cls(spark, folder)
        index.add(vectors, key, vector)
        return index

    def add(self, vectors: DataFrame, key: str, vector: str) -> int:
        """Adds vectors, in place of those with the same key; the new version."""
        number, rows = self.versions.current()
        seq = 1 + max((r.seq for r in rows), default=0)
        own = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
        held = [r for r in rows if r.kind == "vectors"]
        made = []
        if held:
            made += self._stale(own.select("key").distinct(), seq)
        placed = nearest_lists(own, "vector", self.centres, 1).withColumn("seq", F.lit(seq))
        salts = max(1, -(-own.count() // (len(self.centres) * self.rows_a_file)))
        path, n = self.versions.write(placed.repartition("list", F.pmod(F.xxhash64("key"), F.lit(salts))), "vectors", ["list"])
        made += [("vectors", 0, path, seq, None)] if n else []
        return self.versions.publish(number, [*map(tuple, rows), *made])

    def delete(self, keys: DataFrame, key: str) -> int:
        number, rows = self.versions.current()
        seq = 1 + max((r.seq for r in rows), default=0)
        return self.versions.publish(number, [*map(tuple, rows), *self._stale(keys.select(F.col(key).alias("key")).distinct(), seq)])

    def _stale(self, keys: DataFrame, seq: int) -> list[tuple]:
        path, n = self.versions.write(keys.withColumn("dead", F.lit(seq)), "stale")
        return [("stale", 0, path, seq, None)] if n else []

    def vectors(self) -> DataFrame:
        """key, vector, list of every vector that is there."""
        _, rows = self.versions.current()
        paths = [r.path for r in rows if r.kind == "vectors"]
        held = reduce(DataFrame.unionByName, [self.versions.read([p]) for p in paths])
        stale = [r.path for r in rows if r.kind == "stale"]
        if not stale:
            return held
        dead = self.versions.read(stale).groupBy("key").agg(F.max("dead").alias("dead"))
        dead = F.broadcast(dead) if small(dead, MOST_STALE) else dead
        return held.join(dead, "key", "left").where("dead is null or seq >= dead").drop("dead")

    def candidates(self, queries: DataFrame, query_key: str, vector: str, probes: int, block: int = BLOCK) -> DataFrame:
        """query_key, key, score of every pair that is compared; queries are a stated set that meets its lists in blocks, each
        broadcast, so vectors stay where they are read, and the lists that a block's queries don't ask for aren't read."""
        own = queries.select(query_key, F.col(vector).cast("array<float>").alias("_q"))
        asked = written(nearest_lists(own, "_q", self.centres, probes))
        n_blocks, held, parts = max(1, -(-own.count() // block)), self.vectors(), []
        for number in range(n_blocks):
            few = asked.where(F.pmod(F.xxhash64(query_key), F.lit(n_blocks)) == number)
            lists = [r["list"] for r in few.select("list").distinct().collect()]  # `lists` at most
            met = held.where(F.col("list").isin(lists)).join(F.broadcast(few), "list")
            parts.append(met.select(query_key, "key", F.round(similarity(F.col("_q"), F.col("vector"), self.metric), 6).alias("score")))
        return reduce(DataFrame.unionByName, parts)

    def top(self, queries: DataFrame, query_key: str, vector: str, k: int, probes: int, block: int | None = None) -> DataFrame:
        """query_key, key, score (rounded to 6 places), rank of the k most similar vectors in the lists that are probed;
        ties go by key. Queries meet their lists in blocks, as matrices, and only the best of each task leave it."""
        centres, few = self.centres, min(probes, len(self.centres))

        def probed(matrix):
            import numpy as np

            if few == len(centres):
                return np.ones((len(matrix), few), bool)
            centre = np.array(centres)
            found = matrix @ centre.T - (centre * centre).sum(axis=1) / 2
            out = np.zeros(found.shape, bool)
            np.put_along_axis(out, np.argpartition(-found, few - 1, axis=1)[:, :few], True, axis=1)
            return out

        own = queries.select(query_key, F.col(vector).cast("array<float>").alias("_q"))
        return dense_top(own, self.vectors(), query_key, ["key"], "vector", k, self.metric, block, probed)
