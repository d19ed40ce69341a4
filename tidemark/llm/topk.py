"""Operator 9: exact top-k inner products by distributed histogram selection.

Vectors become integers, floor(scale * x).  For every query the score of its k-th best candidate is located without
sorting: each round scores everything, sums a histogram of scores per query over all tasks and keeps the bin the k-th
value is in, split into 1,024 bins in the next round, until a bin is one score wide.  A task sends only the bins its own
k best fall in, as the k-th value overall cannot lie below a task's own.  The bin of the k-th value is found query by query
on the executors; one row a query of the block comes to the driver.  The last pass keeps scores above that value and, of
those equal to it, each task's smallest ids; the few rows left are ranked per query.

Queries are a stated set met by all rows in blocks: blocks of about `block_bytes` of query vectors are cut once and written;
one after the other goes to all tasks as a broadcast, makes its own passes over the table, and has its results written and its
broadcasts destroyed before the next one is read.  Driver and executors hold one block, however many queries there are.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, as query or candidate;
rows with a null id likewise; vectors of another dimension than the query are no candidates for it; an empty vector
takes no part; rows that repeat an id are candidates each, but for the query's own id; fewer than k candidates give all
of them; other columns are ignored.  Scores must fit 63 bits, else the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

K = 10
SCALE = 1024
BINS = 1024
BLOCK_BYTES = 16_000_000
RESULT = "query_id long, rank int, vec_id long, score long"
#: Queries scored at once in a task, and candidates scored at once.
ROWS, COLUMNS = 256, 4096


@dataclass
class Block:
    """Queries of one dimension and what is known of their k-th score: it lies in [low, low + width), `need`-th from the top there."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    width: int
    need: np.ndarray


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, d) of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("d"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def score(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if top < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    if top < 2**62:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    raise OverflowError("inner products leave 63 bits")


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, COLUMNS):
            part = batch.slice(at, COLUMNS)
            yield part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), d)


def top_bins(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's histogram the filled bins from the top until k are counted: row, bin, count."""
    above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
    row, at = np.nonzero((counts > 0) & (above < k))
    return row, at, counts[row, at]


def histograms(rows: DataFrame, d: int, block, k: int) -> DataFrame:
    """(q, bin, n): how many scores of query q fall in each bin of its window; bin BINS holds all scores above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        counts: dict[int, np.ndarray] = {}
        step = -(-b.width // BINS)
        for ids, m in _pieces(batches, d):
            for at in range(0, len(b.ids), ROWS):
                part = slice(at, at + ROWS)
                s = score(b.vectors[part], m)
                bins = np.clip((s - b.low[part, None]) // step, -1, BINS)
                bins[b.ids[part, None] == ids[None, :]] = -1
                n = len(s)
                flat = np.bincount((bins + 1 + np.arange(n)[:, None] * (BINS + 2)).ravel(), minlength=n * (BINS + 2)).reshape(n, -1)[:, 1:]
                row, bin_, c = top_bins(flat, k)
                kept = counts.get(at)
                if kept is None:
                    counts[at] = (row, bin_, c)
                else:  # only the bins of the k best are kept between pieces
                    both = np.zeros((n, BINS + 1), np.int64)
                    both[kept[0], kept[1]] = kept[2]
                    both[row, bin_] += c
                    counts[at] = top_bins(both, k)
        for at, (row, bin_, c) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(row + at, pa.int64()), pa.array(bin_.astype(np.int32)), pa.array(c, pa.int64())], names=["q", "bin", "n"])

    return rows.select("vec_id", "v").mapInArrow(run, "q long, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def refine(block: Block, histogram: DataFrame, k: int) -> tuple[Block, np.ndarray]:
    """Narrow every query's window to the bin of its k-th value, and tell of which queries that was found.

    A query has at most BINS + 1 rows of the histogram; one row of each found query comes to the driver.
    """
    step = -(-block.width // BINS)
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    edge = histogram.withColumn("upto", F.sum("n").over(down)).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
    rows = edge.select("q", "bin", (F.lit(k) - F.col("upto") + F.col("n")).cast("long").alias("need")).toArrow()
    q = rows.column("q").to_numpy()
    found = np.zeros(len(block.ids), bool)
    found[q] = True
    low, need = block.low.copy(), np.zeros(len(block.ids), np.int64)
    low[q] += rows.column("bin").to_numpy().astype(np.int64) * step
    need[q] = rows.column("need").to_numpy()
    return Block(block.ids, block.vectors, low, step, need), found


def cut(queries: DataFrame, scale: int, block_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Queries as (vec_id, v, d, block), written by dimension and block, and the (d, block) that there are.

    Rows are dealt by place, not by id, so that many rows under one id fill no single block.
    """
    asked = materialize(scaled(queries, scale), "queries")
    counts = sorted((r["d"], r["count"]) for r in asked.groupBy("d").count().collect())  # a row for each dimension
    if not counts:
        return asked, []
    blocks = {d: -(-n * 8 * d // block_bytes) for d, n in counts}
    number = F.lit(1)
    for d, n in blocks.items():
        number = F.when(F.col("d") == d, n).otherwise(number)
    path = shared_dir(asked.sparkSession, "query-blocks")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), number.cast("long")))
    dealt.repartition("d", "block").write.partitionBy("d", "block").parquet(path)
    schema = "vec_id long, v array<double>, d int, block long"
    return asked.sparkSession.read.schema(schema).parquet(path), [(d, j) for d, n in blocks.items() for j in range(n)]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query; both sides have (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale)
    asked, blocks = cut(queries, scale, block_bytes)
    path, lengths, best = shared_dir(spark, "top-k"), {}, Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for d, j in blocks:
        table = rows.where(F.col("d") == d)
        if d not in lengths:
            lengths[d] = table.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()["top"]
        part = asked.where((F.col("d") == d) & (F.col("block") == j)).select("vec_id", "v").toArrow()
        if part.num_rows and lengths[d] is not None:
            found, held = _search(spark, table, d, part.combine_chunks(), float(lengths[d]) ** 0.5, k)
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            held.destroy()
    return spark.read.schema(RESULT).parquet(path)


def _search(spark, table: DataFrame, d: int, part: pa.Table, length: float, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, copy, vec_id, score) of all that may be among the k best of a block, and the broadcast that it reads."""
    ids = part.column(0).to_numpy()
    m = _matrix(part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1), d)
    # Cauchy-Schwarz bounds every score; the window is the same for all queries of the block
    bound = int(np.sqrt((m * m).sum(1)).max() * length) + 2
    width = 1
    while width < 2 * bound:
        width *= BINS
    block = Block(ids, m, np.full(len(ids), -bound, np.int64), width, np.full(len(ids), k))
    everything = np.zeros(len(ids), bool)
    while block.width > 1:
        held = spark.sparkContext.broadcast(block)
        block, found = refine(block, histograms(table, d, held, k), k)
        held.destroy()
        everything |= ~found
    least = np.where(everything, -(1 << 62), block.low)  # fewer than k candidates: all of them
    final = spark.sparkContext.broadcast((block, least))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, low = final.value
        ties: dict[int, list[int]] = {}
        for vec, mat in _pieces(batches, d):
            for at in range(0, len(b.ids), ROWS):
                part = slice(at, at + ROWS)
                s = score(b.vectors[part], mat)
                other = b.ids[part, None] != vec[None, :]
                q, c = np.nonzero((s > low[part, None]) & other)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids[q + at]), pa.array(q + at), pa.array(vec[c]), pa.array(s[q, c])], names=["query_id", "copy", "vec_id", "score"])
                q, c = np.nonzero((s == low[part, None]) & other)
                if len(q):
                    order = np.lexsort((vec[c], q))
                    q, v = q[order], vec[c][order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    few = place < k
                    for i, x in zip((q[few] + at).tolist(), v[few].tolist(), strict=True):
                        ties.setdefault(i, []).append(x)
                    for i in set((q + at).tolist()):
                        ties[i] = sorted(ties[i])[: int(b.need[i])]
        flat = [(int(b.ids[i]), i, x, int(low[i])) for i, xs in ties.items() for x in xs]
        for at in range(0, len(flat), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat[at : at + 10_000], strict=True)], names=["query_id", "copy", "vec_id", "score"])

    return table.select("vec_id", "v").mapInArrow(keep, "query_id long, copy long, vec_id long, score long"), final


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
