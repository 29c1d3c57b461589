"""Nearest neighbours by inner product: a forest of random-projection trees with one shared priority queue.

Vectors get one more component that makes all norms equal, so the largest inner product is the nearest neighbour. Trees are
fitted on a bounded sample; every vector is indexed in one leaf of each tree. A query walks all trees through one queue
ordered by the sum of squared margins on the way, and visits the leaves that come first. Leaves are scored exactly, in double
precision on the original vectors, and each query keeps the best of all leaves. Leaves and queries beyond a task's share are
dealt out in chunks, none is left away.

Equal vectors are one entry with their k + 1 least ids, which is all that a query can need of them. Vectors have inner
products with those of their own length only, so each length has a forest of its own.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part; null ids take no part;
rows that repeat an id are entries like any other; ties go to the smaller id; fewer than k candidates are all returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm.workers import tidied
from histoloom.session import stage

#: Entries that one task scores against at once, and queries.
CHUNK_ROWS, CHUNK_QUERIES = 8192, 4096


class Forest:
    """Random-projection trees over a sample; hyperplanes stand between two sampled points."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int):
        rng, sample = np.random.default_rng(seed), sample.astype(np.float32)
        normals, offsets, children, self.roots = [], [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray, depth: int) -> int:
            """The node's number; leaves are below zero."""
            if len(rows) <= leaf_rows or depth > 40:
                self.leaves += 1
                return -self.leaves
            for _ in range(8):
                a, b = sample[rows[rng.integers(len(rows), size=2)]]
                normal = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                along = sample[rows] @ normal
                offset = float(np.median(along))
                left = along <= offset
                if 0.1 < left.mean() < 0.9:
                    break
            else:
                self.leaves += 1
                return -self.leaves
            node = len(normals)
            normals.append(normal), offsets.append(offset), children.append((0, 0))
            children[node] = (grow(rows[left], depth + 1), grow(rows[~left], depth + 1))
            return node

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample)), 0))
        width = sample.shape[1]
        self.normals = np.array(normals, np.float32).reshape(len(normals), width)
        self.offsets, self.children = np.array(offsets, np.float32), children

    def home(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each vector."""
        for root in self.roots:
            out = np.zeros(len(vectors), np.int32)
            stack = [(root, np.arange(len(vectors)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows] = -node
                elif len(rows):
                    left = vectors[rows].astype(np.float32) @ self.normals[node] <= self.offsets[node]
                    stack += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
            yield out

    def nearest_leaves(self, vector: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves by the sum of squared margins on the way, over all trees."""
        margins = self.normals @ vector.astype(np.float32) - self.offsets
        squares = (margins * margins).tolist()
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < most:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                margin, (left, right) = margins[node], self.children[node]
                near, far = (left, right) if margin <= 0 else (right, left)
                heapq.heappush(queue, (cost + squares[node], far))
                node = near
            found.append(-node)
        return found


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector of doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)).where(finite).where(F.exists(v, lambda x: x != 0))


def _norm2(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = 4, leaf_rows: int = 128, sample_rows: int = 8192, visits: int = 64, seed: int = 7
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row for which is_query (over the column id) holds.

    sample_rows bounds the sample that the trees are fitted on; leaf_rows is the size of a leaf in it; a query visits as many
    leaves of all trees together.
    """
    rows = stage(usable(vectors, id_column, vector_column).withColumn("width", F.size("vector")), "vectors")
    widths = [r[0] for r in rows.select("width").distinct().orderBy("width").collect()]  # lengths of vectors: a few
    found = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    for width in widths:
        found = found.union(_nearest_of(rows.where(F.col("width") == width).drop("width"), is_query, k, trees, leaf_rows, sample_rows, visits, seed))
    return found


def _nearest_of(rows: DataFrame, is_query: Column, k: int, trees: int, leaf_rows: int, sample_rows: int, visits: int, seed: int) -> DataFrame:
    """nearest for vectors of one length."""
    largest = rows.agg(F.max(_norm2(F.col("vector")))).first()[0]
    ordered = Window.partitionBy("vector").orderBy("id")
    entries = rows.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stage(entries.withColumn("entry", F.element_at("ids", 1)), "entries")

    order = F.xxhash64("entry", F.lit(seed))
    sample = np.array([r[0] for r in entries.orderBy(order, "entry").limit(sample_rows).select("vector").collect()])
    even = lambda x: np.hstack([x, np.sqrt(np.maximum(0, largest - (x * x).sum(1)))[:, None]])
    forest = rows.sparkSession.sparkContext.broadcast(Forest(even(sample), trees, leaf_rows, seed))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for leaf in forest.value.home(even(matrix(batch.column("vector")))):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("ids"), batch.column("vector")], ["leaf", "ids", "vector"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.value.leaves + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                for leaf in forest.value.home(even(matrix(batch.column("vector")))):
                    total += np.bincount(leaf, minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["leaf", "n"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [forest.value.nearest_leaves(v, visits) for v in even(matrix(batch.column("vector")))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(found, pa.list_(pa.int32()))], ["id", "vector", "leaves"])

    asked = stage(rows.where(is_query).mapInArrow(tidied(probe), "id long, vector array<double>, leaves array<int>"), "asked")
    probes = asked.select("id", "vector", F.explode("leaves").alias("leaf"))
    parts = lambda n, rows_: (F.floor(n / rows_) + 1).cast("int")
    chunks = entries.select("vector").mapInArrow(tidied(sizes), "leaf int, n long").groupBy("leaf").agg(parts(F.sum("n"), CHUNK_ROWS).alias("chunks"))
    asks = probes.groupBy("leaf").agg(parts(F.count("*"), CHUNK_QUERIES).alias("asks"))
    both = F.broadcast(stage(chunks.join(asks, "leaf"), "leaves"))  # a row for each leaf of the bounded sample
    indexed = entries.select("ids", "vector").mapInArrow(tidied(index), "leaf int, ids array<long>, vector array<double>").join(both, "leaf")
    indexed = indexed.withColumn("chunk", F.pmod(F.xxhash64("ids"), "chunks").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    probes = probes.join(both, "leaf").withColumn("ask", F.pmod(F.xxhash64("id"), "asks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def score(asking: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(entry) and len(asking):
            points, ids, asked_ids = np.stack(entry["vector"].to_numpy()), entry["ids"].to_list(), asking["id"].tolist()
            vectors = np.stack(asking["vector"].to_numpy())
            for first in range(0, len(vectors), 256):
                rough = vectors[first : first + 256] @ points.T
                edges = np.partition(rough, -k - 1, axis=1)[:, -k - 1] if len(points) > k + 1 else np.full(len(rough), -np.inf)
                for query, vector, row, edge in zip(asked_ids[first:], vectors[first:], rough, edges):
                    # Sums in a matrix product depend on its shape; what comes near the edge is summed again, each alike.
                    near = np.nonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))[0] if np.isfinite(edge) else np.arange(len(points))
                    scores = (points[near] * vector).sum(1)
                    found = sorted((-s, i) for s, e in zip(scores.tolist(), near.tolist()) for i in ids[e] if i != query)[:k]
                    out["query_id"] += [query] * len(found)
                    out["vec_id"] += [i for _, i in found]
                    out["score"] += [-s for s, _ in found]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["leaf", "chunk", "ask"]
    scored = probes.select(*keys, "id", "vector").groupBy(*keys).cogroup(indexed.select(*keys, "ids", "vector").groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
