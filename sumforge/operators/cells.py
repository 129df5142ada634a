"""A stored index of vectors with exact answers: cells with a centre and a radius, read only while they can matter.

By the angle on the unit sphere, a vector of a cell is no nearer to a query than the centre is, less the cell's radius. A
search takes each query's cells in the order of that bound, a few more in every round, and leaves out all cells that cannot
beat its k-th best so far. What it finds is what a scan of all vectors finds; how much it reads depends on how well the
vectors lie in clusters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.operators.vector import doubles, l2
from sumforge.operators.work import written
from sumforge.sources.snapshots import Snapshots

#: Centres are learnt from at most so many vectors, and there are at most so many: SAMPLE and CENTRES bound what is
#: collected and sent to every task. All vectors are indexed.
SAMPLE, CENTRES = 20_000, 1024
#: Rows of a block of a cell, and of queries that meet it.
BLOCK = 4096
#: Scores are rounded to six places, so a bound has to be lower than the k-th by more than that.
SLACK = 2e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), float).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def centres_of(vectors: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: n unit vectors, begun with vectors far from one another."""
    chosen, far = [0], 1 - vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, 1 - vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


@dataclass
class Search:
    """What was found: (query_id, vec_id, score, rank); rounds it took, and the rows that queries were compared with, of those there are."""

    found: DataFrame
    rounds: int
    read: int
    whole: int

    @property
    def share(self) -> float:
        return self.read / self.whole if self.whole else 0.0


class CellIndex:
    """An index in a folder: tables vectors (cell, block, vec_id, v) and cells (cell, centre, radius, n), in versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.kept = spark, Snapshots(spark, path)

    def build(self, vectors: DataFrame) -> int:
        """Indexes vectors(vec_id, embedding) from the beginning; the new version. Null and zero vectors, which have no direction, are left out."""
        rows = _units(vectors)
        n = rows.count()
        if n > SAMPLE:
            least = rows.select(F.xxhash64("vec_id", F.lit("sample")).alias("h")).agg(F.percentile_approx("h", SAMPLE / n / 2, 10_000)).first()[0]
            sample = rows.where(F.xxhash64("vec_id", F.lit("sample")) <= least).limit(SAMPLE)
        else:
            sample = rows
        taken = np.array([r.v for r in sample.orderBy("vec_id").select("v").collect()], float)
        centres = centres_of(taken, int(min(CENTRES, max(1, round(n**0.5))))) if len(taken) else np.zeros((0, 0))
        return self.kept.replace(self._tables(rows, centres, None))

    def add(self, vectors: DataFrame) -> int:
        """The version with more vectors: they go to the cells there are, whose radius grows where it has to; nothing is read again but the cells."""
        cells = self.kept.table("cells")
        centres = np.array([r.centre for r in cells.orderBy("cell").collect()], float)
        tables = self._tables(_units(vectors), centres, cells)
        return self.kept.commit(append={"vectors": tables["vectors"]}, replace={"cells": tables["cells"]})

    def _tables(self, rows: DataFrame, centres: np.ndarray, cells: DataFrame | None) -> dict[str, DataFrame]:
        def nearest(batches):
            for batch in batches:
                cosine = np.clip(_matrix(batch.column(1)) @ centres.T, -1, 1)
                cell = np.argmax(cosine, axis=1) if len(cosine) else np.zeros(0, int)
                angle = np.arccos(cosine[np.arange(len(cell)), cell]) if len(cosine) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(angle)], ["vec_id", "v", "cell", "angle"])

        placed = written(rows.mapInArrow(nearest, "vec_id long, v array<double>, cell int, angle double"), "placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        if cells is None:
            known = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
            known = known.withColumns({"radius": F.lit(0.0), "n": F.lit(0).cast("long")})
        else:
            known = cells
        more = sizes.withColumnsRenamed({"n": "more", "radius": "wide"})
        after = known.join(more, "cell", "left").select("cell", "centre", F.greatest("radius", F.coalesce("wide", F.lit(0.0))).alias("radius"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        # a large cell is dealt out in blocks; at most CENTRES sizes are sent to all tasks
        placed = placed.join(F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks"))), "cell")
        placed = placed.select("cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v")
        return {"vectors": placed.repartition("cell", "block").sortWithinPartitions("cell", "block", "vec_id"), "cells": written(after, "cells")}

    def search(self, queries: DataFrame, k: int, *, exclude_self: bool = True, first: int = 2) -> Search:
        """The k nearest of queries(query_id, embedding) by cosine, rounded to six places, ties by id: as vector.topk() finds them.

        Every query looks into its first cells, then in each round into twice as many more, in the order of their bounds,
        while these reach its k-th score. A block of a cell meets a block of queries in one matrix product.
        """
        version = self.kept.version()
        vectors, cells = self.kept.table("vectors", version), self.kept.table("cells", version)
        rows = cells.where("n > 0").orderBy("cell").collect()  # at most CENTRES
        numbers, centres = np.array([r.cell for r in rows]), np.array([r.centre for r in rows], float)
        radius, sizes = np.array([r.radius for r in rows]), {r.cell: r.n for r in rows}
        asked = written(_units(queries.withColumnRenamed("query_id", "vec_id")).withColumnRenamed("vec_id", "query_id"), "queries")

        def bounds(batches):
            for batch in batches:
                angle = np.arccos(np.clip(_matrix(batch.column(1)) @ centres.T, -1, 1)) if batch.num_rows else np.zeros((0, len(numbers)))
                bound = np.cos(np.maximum(0, angle - radius))
                order = np.argsort(-bound, axis=1, kind="stable")
                ids = np.repeat(batch.column(0).to_numpy(), len(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers[order].ravel(), pa.int32()), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array(np.tile(np.arange(len(numbers)), len(order)), pa.int32())], ["query_id", "cell", "bound", "place"])

        whole = asked.count() * sum(sizes.values())
        best = self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        if not rows or not whole:
            return Search(best, 0, 0, whole)
        ways = written(asked.mapInArrow(bounds, "query_id long, cell int, bound double, place int"), "bounds")
        low, high, rounds, read = 0, first, 0, 0
        while low < len(numbers):
            last = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            # the cells are in the order of their bounds, so where one falls behind all later ones do
            todo = ways.where((F.col("place") >= low) & (F.col("place") < high)).join(last, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") + SLACK >= F.col("kth")))
            todo = written(todo.select("query_id", "cell"), "pairs")
            per = {r.cell: r.n for r in todo.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CENTRES
            if per:
                rounds += 1
                read += sum(n * sizes[c] for c, n in per.items())
                met = self._met(vectors, asked, todo, per, sizes, k, exclude_self)
                rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
                best = written(best.drop("rank").unionByName(met).withColumn("rank", rank).where(F.col("rank") <= k), "best")
            low, high = high, 3 * high
        return Search(best, rounds, read, whole)

    def _met(self, vectors, asked, todo, per: dict[int, int], sizes: dict[int, int], k: int, exclude_self: bool) -> DataFrame:
        parts = self.spark.createDataFrame([(c, -(-n // BLOCK), -(-sizes[c] // BLOCK)) for c, n in per.items()], "cell int, of int, blocks int")
        rows = vectors.where(F.col("cell").isin(list(per))).join(F.broadcast(parts), "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"), F.col("vec_id").alias("id"), "v", F.lit(False).alias("is_query"))
        asks = todo.join(asked, "query_id").join(F.broadcast(parts), "cell")
        asks = asks.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "of").cast("int").alias("part"), F.col("query_id").alias("id"), "v", F.lit(True).alias("is_query"))

        def run(group: pa.Table) -> pa.Table:
            flag, ids, v = group.column("is_query").to_numpy(zero_copy_only=False), group.column("id").to_numpy(), _matrix(group.column("v"))
            qi, ci, out = ids[flag], ids[~flag], []
            if len(qi) and len(ci):
                score = np.round(v[flag] @ v[~flag].T, 6)
                if exclude_self:
                    score[qi[:, None] == ci[None, :]] = -np.inf
                for row, at in zip(score, qi, strict=True):
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    near = near[np.isfinite(row[near])]
                    near = near[np.lexsort((ci[near], -row[near]))[:k]]
                    out.append(pa.table({"query_id": np.full(len(near), at), "vec_id": ci[near], "score": row[near]}))
            return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        return rows.unionByName(asks).groupBy("cell", "block", "part").applyInArrow(run, "query_id long, vec_id long, score double")


def _units(vectors: DataFrame) -> DataFrame:
    unit = vectors.select("vec_id", l2(doubles(F.col("embedding"))).alias("v"))
    return unit.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0.5)
