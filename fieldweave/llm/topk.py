"""Exact top-k inner products by columnar branch and bound.

Vectors lie dimension by dimension in blocks of eight dimensions. A query goes through these blocks in the
order of its own mass in them, largest first, and adds up its products with all candidates. What the blocks
that are left can still add is at most the sum of the products of both masses in them (Cauchy-Schwarz, block by
block). Candidates whose bound is below the query's k-th best score go, and the others are compacted, so later
blocks read survivors only. A bound that equals the k-th score stays, so ties are exact. The k-th
score is known from the candidates before; strips of candidates grow, so the first, which nothing bounds, is small.

Scale: candidates and queries are stored once, in blocks of bounded size, as files of the shared folder.
A task takes one block of queries and a few blocks of candidates, and reads both from there: no vector is
copied by an exchange or broadcast, and memory is bounded at any input size. A task returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize, new_path

K, SCALE, DIMENSIONS = 20, 64, 8
#: Rows of a stored block of candidates, blocks that a task goes through, most queries of a task, rows of the first strip, most tasks.
CANDIDATE_BLOCK, CHUNK_BLOCKS, QUERY_BLOCK, FIRST_STRIP, MOST_TASKS = 8192, 8, 4096, 256, 100_000


class Search:
    """The best ``k`` of all candidates shown so far, for some queries."""

    def __init__(self, queries: np.ndarray, tags: np.ndarray, k: int, dimensions: int = DIMENSIONS):
        self.q, self.tags, self.k = queries, tags, k
        self.cuts = [(a, min(a + dimensions, queries.shape[1])) for a in range(0, queries.shape[1], dimensions)]
        self.mass = masses(queries.T, self.cuts).T
        self.order = np.argsort(-self.mass, 1, kind="stable")
        self.floor = np.full(len(queries), -np.inf)
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        #: Multiplications done, those for the bounds included, and those of a full scan.
        self.products = self.all_products = 0

    def show(self, columns: np.ndarray, mass: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        """``columns``: dimensions by candidates; ``mass``: their norms in each block of dimensions, blocks by candidates."""
        self.all_products += columns.size * len(self.q)
        if not np.isfinite(self.floor).all():  # nothing to compare with yet
            for r, score in enumerate(self.q @ columns):
                self._merge(r, score, ids, tags)
            self.products += columns.size * len(self.q)
            return
        blocks = [columns[a:b] for a, b in self.cuts]
        for r, q in enumerate(self.q):
            left = self.mass[r] @ mass
            self.products += mass.size
            score = np.zeros(columns.shape[1])
            alive = None  # all
            for b in self.order[r]:
                stays = score + self._slack(left) >= self.floor[r]
                n = np.count_nonzero(stays)
                if n < len(stays):
                    alive = np.flatnonzero(stays) if alive is None else alive[stays]
                    score, left = score[stays], left[stays]
                    if not n:
                        break
                part = blocks[b] if alive is None else blocks[b][:, alive]
                score = score + q[slice(*self.cuts[b])] @ part
                left = left - self.mass[r, b] * (mass[b] if alive is None else mass[b, alive])
                self.products += part.size + part.shape[1]
            enough = np.flatnonzero(score >= self.floor[r])
            if len(enough):
                at = enough if alive is None else alive[enough]
                self._merge(r, score[enough], ids[at], tags[at])

    @staticmethod
    def _slack(bound: np.ndarray) -> np.ndarray:
        """Room for rounding in the square roots and their sums."""
        return bound * (1 + 1e-9) + 1e-3

    def _merge(self, r: int, score: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        own = tags == self.tags[r]
        if own.any():
            score, ids, tags = score[~own], ids[~own], tags[~own]
        score, ids, tags = (np.concatenate(x) for x in zip(self.best[r], (score, ids, tags), strict=True))
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            near = score >= least
            score, ids, tags = score[near], ids[near], tags[near]
        order = np.lexsort((tags, ids, -score))[: self.k]
        self.best[r] = score[order], ids[order], tags[order]
        if len(order) == self.k:
            self.floor[r] = score[order[-1]]


def masses(columns: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Norms in each block of dimensions: blocks by vectors."""
    return np.sqrt(np.stack([(columns[a:b] ** 2).sum(0) for a, b in cuts])) if cuts else np.zeros((0, columns.shape[1]))


def strips(n: int, first: int = FIRST_STRIP, most: int = CANDIDATE_BLOCK) -> Iterator[slice]:
    """Slices of ``n`` rows, each twice as long as the one before."""
    a, size = 0, first
    while a < n:
        yield slice(a, min(a + size, n))
        a, size = a + size, min(2 * size, most)


def _stored(folder: str, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``floor(scale * x)`` of the vectors of a stored block, dimensions by vectors, with ids and tags. Exact as doubles while scores stay below 2**53."""
    system, at = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))
    if not files:
        return None
    table = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(["_tag", "_id", "_v"]) for f in files])
    flat = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.floor(scale * flat).reshape(table.num_rows, -1)
    return np.ascontiguousarray(rows.T), table.column("_id").to_numpy(), table.column("_tag").to_numpy()


def usable(vector: Column) -> Column:
    """Not null, and every component there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id", *, k: int = K, scale: float = SCALE,
    candidate_block: int = CANDIDATE_BLOCK, chunk_blocks: int = CHUNK_BLOCKS, query_block: int = QUERY_BLOCK, first_strip: int = FIRST_STRIP,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row where ``is_query`` holds.

    Rows without a key, or whose vector is null or has null or non-finite components, take no part.
    A row is no candidate for itself; repeated rows are for one another. Only vectors of one length
    meet. Ties go to the smaller key. An empty table gives an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("_tag"), F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"), F.size(vector).alias("_d")), "vectors")
    n, nq = rows.agg(F.count("*"), F.count_if("_q")).first()
    query_block = min(query_block, max(64, -(-nq // (2 * spark.sparkContext.defaultParallelism))))
    across, down = max(1, -(-n // candidate_block)), max(1, -(-nq // query_block))
    chunks = -(-across // chunk_blocks)
    offered, wanted = new_path(spark, "candidates"), new_path(spark, "queries")
    for path, some, count in ((offered, rows, across), (wanted, rows.where("_q"), down)):
        dealt = some.select("_tag", "_id", "_v", "_d", F.pmod(F.xxhash64("_tag"), F.lit(count)).cast("int").alias("_block"))
        dealt.repartition("_d", "_block").write.partitionBy("_d", "_block").parquet(path)
    ranged = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    units = rows.where("_q").select("_d").distinct().select("_d", ranged(down).alias("_down")).select("_d", "_down", ranged(chunks).alias("_chunk"))
    units = units.repartition(min(MOST_TASKS, max(1, down * chunks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, q, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                asked = _stored(f"{wanted}/_d={d}/_block={q}", scale)
                if asked is None:
                    continue
                search = Search(np.ascontiguousarray(asked[0].T), asked[2], k)
                for block in range(c * chunk_blocks, min((c + 1) * chunk_blocks, across)):
                    if (there := _stored(f"{offered}/_d={d}/_block={block}", scale)) is None:
                        continue
                    columns, ids, tags = there
                    mass = masses(columns, search.cuts)
                    for at in strips(len(ids), first_strip if not np.isfinite(search.floor).all() else candidate_block):
                        search.show(columns[:, at], mass[:, at], ids[at], tags[at])
                found = [(np.full(len(score), asked[2][r]), np.full(len(score), asked[1][r]), ids, score.astype(np.int64), tags) for r, (score, ids, tags) in enumerate(search.best)]
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["_query", "query_id", "vec_id", "score", "_tag"])

    found = units.mapInArrow(run, "_query long, query_id long, vec_id long, score long, _tag long")
    rank = F.row_number().over(W.partitionBy("_query").orderBy(F.desc("score"), "vec_id", "_tag"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """``op2_top_k``: the 20 best rows for every 20th vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS tag, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.tag AS qtag, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.tag <> c.tag WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY qtag ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
