"""Operator 5: best-fit packing with patterns fitted by non-negative least squares.

The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) goes to the driver.  Lengths are
rounded up to `width` tokens, patterns of one to three rounded lengths that fill a sequence are enumerated, and repeat
counts are fitted to the rounded histogram by non-negative least squares (Lawson-Hanson) and rounded down.
Patterns are then filled with true lengths, longest first, and the pieces left over are packed by best fit, decreasing,
into the room that patterns leave and into new sequences - all on counts of lengths, not on pieces.

Pieces are ranked within their length - by salted groups with offsets, so that a common length is no hot group; the
salts are dealt in turn and written with the pieces, so neither is one id, a missing id or one text - and a rank is looked
up in the plan's slots, a table whose size depends on the capacity only.

Defined results: null text is an empty document (its end id only); an empty table gives no row; rows repeated or with a
null doc_id are packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import in_parts, materialize, tidy
from .tokens import END_ID, default_path, word_encoder

CAPACITY = 4096
#: Rows and bytes of text encoded at once, and words kept: less than for shards, as in the pipeline other stages' workers live on beside these.
ROWS, BYTES, CACHE_WORDS = 1_000, 2_000_000, 200_000
WIDTH = 32
DEPTH = 3
#: Pieces of one salted group of a length, about.
GROUP_ROWS = 200_000
SALTS = 64
#: How far apart tasks start to deal; prime, so that they start in different groups.
TURN = 1_000_003


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, turn): documents as token pieces of at most `capacity`, numbered in turn to be dealt."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = word_encoder(path, end_id, cache_words), TaskContext.get().partitionId() * TURN
        for batch in in_parts(tidy(batches), ROWS, "text", BYTES):
            ids, edge = encoder.encode_column(batch.column(1))
            n = np.maximum(1, -(-np.diff(edge) // capacity))
            piece = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            lo = np.repeat(edge[:-1], n) + piece * capacity
            hi = np.minimum(lo + capacity, np.repeat(edge[1:], n))
            data = memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array((turn + np.arange(len(piece))).astype(np.int64))]
            turn += len(piece)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long")


def patterns(units: int, depth: int, present: set[int]) -> list[tuple[int, ...]]:
    """Descending tuples of up to `depth` present sizes that sum to `units`."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], room: int, most: int) -> None:
        if room == 0:
            out.append(prefix)
        elif len(prefix) < depth:
            for s in range(min(most, room), 0, -1):
                if s in present and s * (depth - len(prefix)) >= room:
                    grow((*prefix, s), room - s, s)

    grow((), units, units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, bool]:
    """argmin |a x - b|, x >= 0, by the active-set method of Lawson and Hanson, and whether it got there within the rounds."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    eps = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= eps:
            return x, True
        active[j] = True
        while active.any():
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 1e-12:
                x = s
                break
            low = active & (s <= 1e-12)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
    return x, False


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many alike) that hold every piece of the histogram once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        done.append(((capacity,), left.pop(capacity)))
    units = capacity // width
    stock: dict[int, list[list[int]]] = defaultdict(list)  # by rounded size: [length, count], shortest first
    for n in sorted(left):
        stock[-(-n // width)].append([n, left[n]])
    have = {u: sum(c for _, c in runs) for u, runs in stock.items()}
    tuples = patterns(units, depth, set(stock))
    if tuples:
        sizes = sorted(stock)
        at = {u: i for i, u in enumerate(sizes)}
        a = np.zeros((len(sizes), len(tuples)))
        for j, t in enumerate(tuples):
            for u in t:
                a[at[u], j] += u
        b = np.array([have[u] * u for u in sizes], float)
        # counts that the rounds did not bring to the optimum are still counts: what they leave is packed by best fit
        fitted = nnls(a, b / b.max())[0] * b.max()
        for j in np.argsort(-fitted, kind="stable"):
            t = tuples[j]
            count = min(int(fitted[j]), *(have[u] // t.count(u) for u in set(t)))
            if count <= 0:
                continue
            # all but the last slot take the longest pieces of their size; the last takes the longest that still fits
            streams = [_take(stock[u], count) for u in t[:-1]] or [[[0, count]]]
            for u in t[:-1]:
                have[u] -= count
            for lengths, m in _merge(streams):
                lengths = tuple(n for n in lengths if n)
                room = capacity - sum(lengths)
                while m:
                    u = max((u for u in range(min(units, t[-1] + len(t)), 0, -1) if have.get(u) and stock[u][0][0] <= room), default=0)
                    if not u:
                        done.append((lengths, m))
                        break
                    runs = stock[u]
                    i = bisect_right(runs, room, key=lambda r: r[0]) - 1
                    k = min(m, runs[i][1])
                    done.append(((*lengths, runs[i][0]), k))
                    m -= k
                    have[u] -= k
                    runs[i][1] -= k
                    if not runs[i][1]:
                        runs.pop(i)
    rest = sorted(((n, c) for runs in stock.values() for n, c in runs if c), reverse=True)
    return _best_fit(done, rest, capacity)


def _take(runs: list[list[int]], count: int) -> list[list[int]]:
    """Take `count` pieces off the longest end."""
    out = []
    while count:
        m = min(count, runs[-1][1])
        out.append([runs[-1][0], m])
        runs[-1][1] -= m
        count -= m
        if not runs[-1][1]:
            runs.pop()
    return out


def _merge(streams: list[list[list[int]]]) -> list[tuple[tuple[int, ...], int]]:
    """Runs side by side as runs of tuples."""
    out, at, streams = [], [0] * len(streams), [[r[:] for r in s] for s in streams]
    while at[0] < len(streams[0]):
        heads = [s[i] for s, i in zip(streams, at, strict=True)]
        m = min(h[1] for h in heads)
        out.append((tuple(h[0] for h in heads), m))
        for k, h in enumerate(heads):
            h[1] -= m
            at[k] += h[1] == 0
    return out


def _best_fit(open_: list[tuple[tuple[int, ...], int]], rest: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on runs of equal sequences."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        room = capacity - sum(lengths)
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((lengths, count))

    for lengths, count in open_:
        put(lengths, count)
    for n, c in rest:
        while c:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                per = capacity // n
                if c >= per:
                    put((n,) * per, c // per)
                if c % per:
                    put((n,) * (c % per), 1)
                break
            room = rooms[i]
            lengths, count = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            m = min(c, count)
            if m < count:
                put(lengths, count - m)
            put((*lengths, n), m)
            c -= m
    return [g for room in sorted(groups) for g in groups[room]]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), ordered by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in planned:
        at = 0
        for n in lengths:
            rows.append((n, used[n], count, sequence, at))
            used[n] += count
            at += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(p: DataFrame, rows: int) -> DataFrame:
    """Pieces with their rank within their length, from 0."""
    salts = max(SALTS, -(-rows // GROUP_ROWS))
    salted = p.withColumn("salt", F.pmod("turn", F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("o_length"), F.col("salt").alias("o_salt"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("turn")) - 1
    numbered = salted.withColumn("own", own)
    return numbered.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("salt") == F.col("o_salt"))).withColumn("rank", F.col("own") + F.col("before"))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs (doc_id, text).

    cache_words: distinct words that a process keeps; it changes memory and time only.
    """
    p = materialize(pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id, cache_words=cache_words), "pieces")
    histogram = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}  # at most `capacity` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = table.value
        keys = slot[:, 0] << 44 | slot[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = np.searchsorted(keys, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slot[k, 3] + rank - slot[k, 1]), pa.array(slot[k, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked(p, sum(histogram.values())).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
