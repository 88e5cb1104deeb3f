"""A stored index of vectors: members of the cells of a coarse clustering, searched in as many of the nearest cells as a measured recall needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ranking import nearest_rows, top, vector_top
from quern.shared import cut, new_path, spread, stored

#: Cells are the square root of the number of vectors, at most so many; rows that the clustering is fitted on, a cell.
MOST_CELLS, FITTED_ON = 1024, 256
#: Queries that the number of cells to search is fitted on, the neighbours of each, and the part of them to be found.
MEASURED, NEIGHBOURS, RECALL = 64, 10, 0.95
#: Vectors of cells, and queries, that one task compares.
BLOCK, QUERY_BLOCK = 50_000, 32_768


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them null, as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _bounded(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of vec_id."""
    return rows.where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20)))


def build_cells(vectors: DataFrame, cells: int | None = None, recall: float = RECALL, seed: int = 7) -> Cells:
    """Write the members of each cell of ``vectors`` (vec_id, embedding and others), all of one length.

    The clustering, k-means on unit vectors, is fitted on about ``FITTED_ON`` rows a cell; all rows are members. Vectors null,
    zero, or holding null or no finite number are left out. For about ``MEASURED`` rows the exact neighbours are found; the number of
    cells to search is the smallest at which the part ``recall`` of those neighbours lie in them.
    """
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession, "cells")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    fine = vectors.withColumn("_norm", norm).where((F.col("_norm") > 0) & (F.col("_norm") < float("inf")) & ~F.isnan("_norm"))
    unit = F.transform("embedding", lambda x: x / F.col("_norm"))
    n = fine.count()
    k = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
    held = spread(fine).withColumn("_unit", array_to_vector(unit)).drop("_norm")
    sample = cut(_bounded(held.select("vec_id", "_unit"), n, k * FITTED_ON))
    model = KMeans(k=k, seed=seed, featuresCol="_unit", predictionCol="cell", maxIter=10).fit(sample) if n else None
    placed = model.transform(held) if model else held.withColumn("cell", F.lit(0))
    members = placed.withColumn("part", (F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // BLOCK))))).cast("int")).drop("_unit")
    members.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/members")
    centres = [(j, [float(x) for x in c]) for j, c in enumerate(model.clusterCenters())] if model else []  # at most MOST_CELLS vectors
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    made = Cells(spark, path, members.schema, k)
    asked = cut(_bounded(held.select("vec_id", "embedding"), n, MEASURED))
    near = vector_top(fine.select("vec_id", "embedding"), asked, NEIGHBOURS + 1).where("query_id <> vec_id")
    order = made.ordered(asked, k).select("query_id", F.col("cell"), "place")
    found = near.join(placed.select("vec_id", "cell"), "vec_id").join(order, ["query_id", "cell"])
    reach = found.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell at most
    total, seen, probes = sum(r.n for r in reach), 0, 1
    for r in reach:
        if seen >= recall * total:
            break
        seen, probes = seen + r.n, r.place
    spark.createDataFrame([(probes, n)], "probes int, n long").coalesce(1).write.parquet(f"{path}/meta")
    return Cells(spark, path, members.schema, k, probes, n)


class Cells:
    """A written index: ``members`` by cell, ``probes`` cells to search a query, ``n`` vectors."""

    def __init__(self, spark: SparkSession, path: str, schema=None, k: int = 0, probes: int = 0, n: int = 0):
        self.spark, self.path, self.probes, self.n = spark, path, probes, n
        self.members = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/members")
        self.centres = np.array([r.centre for r in spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()])
        if not probes and not schema:
            self.probes, self.n = spark.read.parquet(f"{path}/meta").first()

    @property
    def _near(self) -> Callable[[pa.Array, int], np.ndarray]:
        """The cells of the nearest centres of each vector, in that order."""
        centres = self.centres

        def near(vectors: pa.Array, probes: int) -> np.ndarray:
            if not len(vectors) or not len(centres):
                return np.zeros((len(vectors), 0), np.int64)
            v = np.array(vectors.to_pylist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            far = (centres**2).sum(axis=1) - 2 * v @ centres.T
            return np.argsort(far, axis=1, kind="stable")[:, :probes]

        return near

    def ordered(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding, cell, place): the ``probes`` cells whose centres are nearest to each query (vec_id, embedding), from 1."""
        near, some = self._near, len(self.centres)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and some:
                    cells = near(batch.column(1), probes)
                    row = np.repeat(np.arange(len(cells)), cells.shape[1])
                    place = np.tile(np.arange(1, cells.shape[1] + 1), len(cells))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cells.ravel().astype(np.int32)), pa.array(place.astype(np.int32))], ["query_id", "embedding", "cell", "place"])

        rows = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(nearest, "query_id long, embedding array<double>, cell int, place int")

    def _tiles(self) -> dict[int, tuple[int, int]]:
        """(first tile, number of tiles) of each cell: about ``BLOCK`` vectors a tile; a small cell shares one, a large one is dealt over several."""
        sizes = self.members.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()  # a row a cell, at most MOST_CELLS
        found, before = {}, 0
        for r in sizes:
            found[r.cell] = (before // BLOCK, -(-r.n // BLOCK))
            before += r.n
        return found

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, distance, rank): the nearest members of each query's cells by cosine distance, ties to smaller ids; a query finds itself.

        A query's vector goes once to each tile of members that holds a cell of its own, with the numbers of those cells, and a tile's members
        once to each block of queries: neither is sent again for each cell. Only cells that are asked for are compared.
        """
        tiles, probes = self._tiles(), probes or self.probes
        count, parts = max((a + n for a, n in tiles.values()), default=0), max(1, -(-queries.count() // QUERY_BLOCK))
        inside = np.zeros((count, len(self.centres)), bool)
        for cell, (a, n) in tiles.items():
            inside[a : a + n, cell] = True
        near = self._near

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = near(batch.column(1), probes)
                asked = np.zeros((batch.num_rows, inside.shape[1]), bool)
                np.put_along_axis(asked, cells, True, axis=1)
                for tile in range(count):
                    row, cell = np.nonzero(asked & inside[tile])
                    some, first = np.unique(row, return_index=True)
                    if len(some):
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                        at = pa.array(some)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(some), tile, np.int32)), lists], ["query_id", "embedding", "tile", "cells"])

        rows = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        sent = rows.mapInArrow(send, "query_id long, embedding array<double>, tile int, cells array<int>").withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        places = self.spark.createDataFrame([(cell, a, n) for cell, (a, n) in tiles.items()], "cell int, first int, tiles int")
        of = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
        read = self.members.join(F.broadcast(places), "cell").select(of.alias("of_tile"), "cell", F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_part"))

        def meet(queries: pa.Table, members: pa.Table) -> pa.Table:
            unit = lambda t: (v := _matrix(t["embedding"].combine_chunks())) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            if len(queries) and len(members):
                members = members.sort_by("cell")
                ids, asking, u, v = members["vec_id"].to_numpy(), queries["query_id"].to_numpy(), unit(queries), unit(members)
                cells, lists = members["cell"].to_numpy(), queries["cells"].combine_chunks()
                asked = np.zeros((len(asking), cells.max() + 1), bool)
                row, cell = np.repeat(np.arange(len(asking)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                here = cell <= cells.max()  # a tile may hold no member of a cell that is dealt over several
                asked[row[here], cell[here]] = True
                for a in range(0, len(asking), 256):
                    some = asked[a : a + 256]
                    wanted = some.any(axis=0)[cells]
                    distance = np.round(1 - u[a : a + 256] @ v[wanted].T, 6) + 0.0
                    distance[~some[:, cells[wanted]]] = np.inf
                    row, best = nearest_rows(distance, ids[wanted], k)
                    for column, values in zip(out, (asking[a + row], ids[wanted][best], distance[row, best]), strict=True):
                        column.append(values)
            return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "distance"])

        found = sent.groupBy("tile", "query_part").cogroup(read.groupBy("of_tile", "of_part")).applyInArrow(meet, "query_id long, vec_id long, distance double")
        return top(found.withColumn("_near", -F.col("distance")), k, "_near", "vec_id").drop("_near")

    def part_read(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, part): how much of the table each query's cells hold."""
        sizes = self.members.groupBy("cell").agg(F.count("*").alias("_n"))
        return self.ordered(queries, probes or self.probes).drop("embedding").join(F.broadcast(sizes), "cell").groupBy("query_id").agg((F.sum("_n") / F.lit(max(self.n, 1))).alias("part"))


def stored_cells(vectors: DataFrame, name: str) -> Cells:
    """The cells of ``vectors`` that the shared folder holds, or new ones where the table's files have changed since."""
    return Cells(vectors.sparkSession, stored(vectors, f"cells {name}", lambda: build_cells(vectors).path))
