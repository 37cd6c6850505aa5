"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample. Every vector is indexed in the list of its nearest centroid and, if it lies near a boundary, in those of
other centroids within a distance ratio. Centroids are found by a search in an in-memory graph of their neighbours. A query reads the lists whose
centroid's distance is within a ratio of the nearest one's. Lists are cut into chunks of bounded size, so a list with very many
vectors is many tasks' work. Equal vectors are one entry with its K + 1 smallest ids, which is all that K nearest with ties to the smaller id can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlattice.llm.staging import staged

K = 5
#: Rows of the sample that centroids are fitted on, and centroids, at most.
SAMPLE = 20_000
CENTROIDS = 4_096
#: Vectors per list aimed at.
LIST = 200
#: A vector is replicated to centroids up to this times as far as its nearest one, a query reads lists up to that far.
REPLICATE = 1.10
PROBE = 1.35
#: A query goes on to farther lists until those it reads hold so many vectors.
ENOUGH = 400
#: Vectors, or queries, of one list that one task compares.
CHUNK = 4_096
#: Neighbours per centroid in the graph, and candidates kept during a search.
DEGREE = 24
BEAM = 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; the largest component is divided out first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """For each row of x the k rows of y with the largest dot product, in blocks."""
    out = []
    for i in range(0, len(x), 1024):
        dots = x[i : i + 1024] @ y.T
        part = np.argpartition(-dots, k - 1, axis=1)[:, :k] if k < len(y) else np.broadcast_to(np.arange(len(y)), (len(dots), len(y)))
        out.append(np.take_along_axis(part, np.argsort(-np.take_along_axis(dots, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


@dataclass
class Graph:
    """Unit centroids, their neighbours, and where a search begins."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        near = _nearest(centroids, centroids, min(DEGREE + 1, n))
        # links to random others keep the graph connected
        far = np.random.default_rng(7).integers(0, n, (n, 4))
        return cls(centroids, np.concatenate([near, far], axis=1), np.unique(np.linspace(0, n - 1, min(n, BEAM // 2)).astype(int)))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for all rows of x at once: BEAM (or all) centroids and their distances, nearest first."""
        rows, width = len(x), min(BEAM, len(self.centroids))
        ids = np.broadcast_to(self.entries[:width], (rows, len(self.entries[:width])))
        best, dist = self._kept(x, ids, width)
        done = np.zeros(best.shape, dtype=bool)
        while True:
            # the 4 nearest candidates whose neighbours have not been looked at
            rank = np.argsort(done, axis=1, kind="stable")[:, :4]
            fresh = ~np.take_along_axis(done, rank, 1) & np.isfinite(np.take_along_axis(dist, rank, 1))
            live = fresh.any(axis=1)
            if not live.any():
                return best, dist
            np.put_along_axis(done, rank, True, 1)
            chosen = np.where(fresh, np.take_along_axis(best, rank, 1), np.take_along_axis(best, rank[:, :1], 1))[live]
            seen = np.where(done[live], best[live], -1)
            ids = np.concatenate([best[live], self.neighbours[chosen].reshape(len(chosen), -1)], axis=1)
            b, d = self._kept(x[live], ids, width)
            best[live], dist[live] = b, d
            done[live] = (b[:, :, None] == seen[:, None, :]).any(axis=2)

    def _kept(self, x: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(ids, axis=1)
        again = np.zeros(ids.shape, dtype=bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        dots = np.einsum("rd,rkd->rk", x, self.centroids[ids])
        d = np.sqrt(np.maximum(0, 2 - 2 * dots))
        d[again] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        if ids.shape[1] < width:
            more = width - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, more)), mode="edge")
            d = np.pad(d, ((0, 0), (0, more)), constant_values=np.inf)
        return ids, d


def centroids(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over unit vectors; an empty cluster takes the vector that lies worst."""
    rng = np.random.default_rng(3)
    made = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        own = _nearest(sample, made, 1)[:, 0]
        sums = np.zeros_like(made)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(length < 1e-9)
        if len(empty):
            worst = np.argsort(np.einsum("rd,rd->r", sample, made[own]), kind="stable")[: len(empty)]
            sums[empty[: len(worst)]], length[empty[: len(worst)]] = sample[worst], 1
        made = sums / np.where(length > 1e-9, length, 1)[:, None]
    return made


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>): rows that have an id and a non-zero vector of finite components."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    )


def fit(distinct: DataFrame) -> Graph | None:
    """Centroids and their graph from at most SAMPLE distinct vectors (column embedding), chosen by hash; None if there is none."""
    n = distinct.count()
    if not n:
        return None
    dice = F.xxhash64("embedding")
    least = int(-(2**63) + min(1.0, 2 * SAMPLE / n) * (2**64 - 1)) if n > 2 * SAMPLE else 2**63 - 1
    rows = distinct.where(dice <= least).select("embedding").orderBy(dice).limit(SAMPLE).toArrow()
    sample = unit(_matrix(rows.column("embedding").combine_chunks()))
    return Graph.of(centroids(sample, int(np.clip(n // LIST, 1, min(CENTROIDS, len(sample))))))


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(embedding, ids): each distinct vector and its n smallest ids. The rank is cut in every task before the shuffle, so a vector may have any number of rows."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.select("embedding", "vec_id").distinct().withColumn("_rank", rank).where(F.col("_rank") <= n)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _lists(rows: DataFrame, graph: Graph, ratio: float, sizes: np.ndarray, keep: str = "embedding") -> DataFrame:
    """rows with column list, once for each centroid within `ratio` of the nearest distance, and nearest ones until they hold ENOUGH vectors.

    sizes: vectors per list; without them the nearest centroid alone is enough.
    """
    sent = rows.sparkSession.sparkContext.broadcast((graph, sizes))
    fields = [*rows.schema.fields]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", list int"
    at = [f.name for f in fields].index(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, d = sent.value[0].search(unit(_matrix(part.column(at))))
                held = sent.value[1][ids]
                few = np.cumsum(held, axis=1) - held < ENOUGH
                near = (d <= d[:, :1] * ratio) | few & np.isfinite(d)
                row, place = np.nonzero(near)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[row, place].astype(np.int32))], [*part.schema.names, "list"])

    return rows.mapInArrow(run, kind)


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the column condition holds, its k nearest other rows by cosine, ties to the smaller vec_id.

    Unusable vectors (null, zero, null or non-finite components) take no part, nor do rows without an id; all usable vectors must
    have one length. Rows equal in id and vector are one, and a query never finds its own id. With k or fewer candidates all are found.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors).withColumn("is_query", is_query), "vectors")
    entries = staged(_smallest_ids(rows, k + 1), "entries")
    graph = fit(entries)
    found_kind = "query_id bigint, vec_id bigint, score double"
    if graph is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = np.full(len(graph.centroids), ENOUGH)
    posted = staged(_lists(entries, graph, REPLICATE, sizes), "postings")
    counts = posted.groupBy("list").count().toArrow()  # at most CENTROIDS rows
    sizes = np.zeros(len(graph.centroids), dtype=np.int64)
    sizes[counts.column("list").to_numpy()] = counts.column("count").to_numpy()
    asked = staged(_lists(rows.where("is_query").select("vec_id", "embedding").distinct(), graph, PROBE, sizes), "probes")
    # lists of more than CHUNK vectors or queries are cut; each chunk of vectors meets each chunk of queries
    sizes = posted.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("q")), "list")
    sizes = sizes.select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"), F.ceil(F.col("q") / CHUNK).cast("int").alias("turns"))
    sizes = F.broadcast(staged(sizes, "list-sizes"))  # at most CENTROIDS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(sizes, "list").select("list", F.pmod(F.xxhash64("embedding"), F.col("parts")).cast("int").alias("part"), spread("turns").alias("turn"), "ids", "embedding")
    right = asked.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int").alias("turn"), spread("parts").alias("part"), "vec_id", "embedding")

    def compare(entry: pa.Table, query: pa.Table) -> pa.Table:
        x, q = _matrix(entry.column("embedding").combine_chunks()), _matrix(query.column("embedding").combine_chunks())
        names = query.column("vec_id").to_numpy()
        out = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0)]
        if len(x) and len(q):
            ids = entry.column("ids").to_pylist()
            long = np.sqrt(np.einsum("rd,rd->r", x, x))
            for i in range(0, len(q), 256):
                part = q[i : i + 256]
                score = part @ x.T / long / np.sqrt(np.einsum("rd,rd->r", part, part))[:, None]
                top = min(k + 2, len(x))
                best = np.argpartition(-score, top - 1, axis=1)[:, :top]
                cut = np.take_along_axis(score, best, 1).min(axis=1)
                for r, name in enumerate(names[i : i + 256].tolist()):
                    at = np.flatnonzero(score[r] >= cut[r] - 1e-12)  # all that may tie with the last one kept
                    got = [(v, int(e)) for e in at.tolist() for v in ids[e] if v != name]
                    exact = {int(e): float(np.dot(part[r], x[e]) / (long[e] * np.sqrt(np.dot(part[r], part[r])))) for e in at}
                    got = sorted((-exact[e], v) for v, e in got)[:k]
                    out[0].append(np.array([(name, v) for _, v in got], dtype=np.int64).reshape(-1, 2))
                    out[1].append(np.array([-s for s, _ in got]))
        pairs, score = np.concatenate(out[0]), np.concatenate(out[1])
        return pa.table({"query_id": pairs[:, 0], "vec_id": pairs[:, 1], "score": score})

    keys = ["list", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, found_kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
