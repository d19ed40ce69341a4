"""Operator 2: SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits.  The anchors are the words of a covering code: two perfect [23, 12] Golay codes side by side
(covering radius 3 each, so 6 together) on 46 bits of the fingerprint, any value on the other 18.  Every fingerprint is
within the radius of one *home* anchor and is replicated to every anchor within radius + threshold.  If x and y differ
in at most `threshold` bits, y is among the replicas at the home of x, so comparing homes with replicas, anchor by
anchor, finds every link.  A fingerprint has about 78 replicas of 17 bytes, whatever the number of documents, and the
2^24 anchors keep the groups small.

Only distinct fingerprints are compared; a group of copies is one of them.  Within an anchor homes are held (in blocks,
if there are very many: `home_block`) while its replicas stream by, and only a spanning forest of the links is passed
on, never all pairs; in a crowded anchor most pairs of rows that are connected already are not compared either.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
a null doc_id never becomes a component id unless all ids of the component are null; repeated rows each get a row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts, materialize, small_or_shuffled, tidy
from .components import star_components

SEED = 42
BITS = 64
RADIUS = 6
GOLAY = 0xC75  # generator polynomial of the [23, 12] code
BLOCK = 23


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles; ASCII lower case."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), SEED)
    h = np.fromiter((hashed(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)), strict=False)), "<u8", len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(tidy(batches), 1000, "text", 8_000_000):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache
def _code(most: int):
    """For every syndrome the vectors of its coset up to a weight: vectors by (syndrome, weight), where each syndrome starts, how many weigh up to w."""
    step = np.arange(1 << BLOCK, dtype=np.int32)
    weight = np.bitwise_count(step)
    step, weight = step[weight <= most], weight[weight <= most]
    left = step.copy()
    for bit in range(BLOCK - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - 11)), left)
    order = np.lexsort((step, weight, left))
    vectors, syndrome, weight = step[order].astype(np.int64), left[order], weight[order]
    start = np.searchsorted(syndrome, np.arange(1 << 11))
    upto = np.zeros((1 << 11, most + 1), np.int64)
    np.add.at(upto, (syndrome, weight), 1)
    return vectors, start, upto.cumsum(1)


def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for bit in range(BLOCK - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - 11)), left)
    return left


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within `reach` of each fingerprint (int64): index of the fingerprint, anchor, and whether it is its home."""
    vectors, start, upto = _code(reach)
    bits = fps.view(np.uint64)
    w1, w2 = (((bits >> np.uint64(s)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for s in (0, BLOCK))
    s1, s2 = _syndrome(w1), _syndrome(w2)
    lead = (upto[s1] > 0).argmax(1)
    out = []
    for a in range(reach + 1):
        before = upto[s1, a - 1] if a else 0
        n1, n2 = upto[s1, a] - before, upto[s2, reach - a]
        n = n1 * n2
        index = np.repeat(np.arange(len(fps)), n)
        local = np.arange(len(index)) - np.repeat(n.cumsum() - n, n)
        i1, i2 = np.divmod(local, n2[index])
        c1 = w1[index] ^ vectors[(start[s1] + before)[index] + i1]
        c2 = w2[index] ^ vectors[start[s2][index] + i2]
        out.append((index, c1 << BLOCK | c2, (lead[index] == a) & (i2 == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def home_anchor(fps: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius of the code's two halves."""
    vectors, start, _ = _code(3)
    bits = fps.view(np.uint64)
    w1, w2 = (((bits >> np.uint64(s)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for s in (0, BLOCK))
    return (w1 ^ vectors[start[_syndrome(w1)]]) << BLOCK | (w2 ^ vectors[start[_syndrome(w2)]])


def lowest(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node 0, 1, ... reaches, from the smallest known so far and further links (a, b)."""
    while True:
        apart = low[a] != low[b]
        if not apart.any():
            return low
        a, b = a[apart], b[apart]
        u, v, low = low[a], low[b], low.copy()
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) as one star a component: every node of it but the smallest, and the smallest."""
    node, at = np.unique(np.r_[u, v], return_inverse=True)
    low = lowest(np.arange(len(node)), at[: len(u)], at[len(u) :])
    moved = low != np.arange(len(node))
    return node[moved], node[low[moved]]


#: Homes of a crowded anchor that lead first, and how many times more in each round after it.
LEADING_HOMES, MORE_HOMES = 16, 4


def crowded(prints: np.ndarray, homes: int, threshold: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """What `links` gives for the one run of these rows, without most pairs of rows that are known to be connected.

    Some homes are compared with all rows; then those outside the largest component, ever more in a round. The homes that are left are
    all in that component, so only rows outside it can gain by them.
    """
    node, at = np.unique(prints[:, 0], return_inverse=True)
    low, every, left, leads = np.arange(len(node)), np.arange(len(prints)), np.arange(homes), LEADING_HOMES

    def compared(some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found, step = low, max(1, pairs // max(1, len(some)))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            r, h = np.nonzero(np.bitwise_count((prints[part][:, None] ^ prints[some]).view(np.uint64)).sum(2, dtype=np.int64) <= threshold)
            found = lowest(found, at[part[r]], at[some[h]])
        return found

    while True:
        main = np.bincount(low[at]).argmax()
        outside = low[at[left]] != main
        if not outside.any():
            break
        some = left[outside][:leads]
        low, left, leads = compared(some, every), np.setdiff1d(left, some), leads * MORE_HOMES
    low = compared(left, every[low[at] != main])
    moved = low != np.arange(len(node))
    return node[moved], node[low[moved]]


def links(run: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int, pairs: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the homes and all rows of each run of equal numbers (homes first), as stars around the smallest of what they connect.

    prints: a row of fingerprints for each row, compared together; the first one names the row.
    """
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    busy = (homes > 0) & (size > 1)
    many = busy & (homes > LEADING_HOMES) & (homes * size > pairs // 8)
    for at, n, h in zip(first[many], size[many], homes[many], strict=True):
        yield crowded(prints[at : at + n], int(h), threshold, pairs)
    few = busy & ~many
    first, size, homes = first[few], size[few], homes[few]
    if not len(first):
        return
    name = prints[:, 0]
    row = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
    n, at = np.repeat(homes, size), np.repeat(first, size)
    end = n.cumsum()
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + pairs, "right")))
        m = n[lo:hi]
        r = np.repeat(row[lo:hi], m)
        h = np.repeat(at[lo:hi], m) + np.arange(len(r)) - np.repeat(m.cumsum() - m, m)
        near = (np.bitwise_count((prints[r] ^ prints[h]).view(np.uint64)).sum(1, dtype=np.int64) <= threshold) & (name[r] != name[h])
        if near.any():
            yield stars(name[r[near]], name[h[near]])
        lo = hi


def near_links(distinct: DataFrame, threshold: int = 2, home_block: int = 4096, *, codes: tuple[str, ...] = ("fp",), prints: tuple[str, ...] = ("fp",), spread: int | None = None) -> DataFrame:
    """Links (u, v), u > v, that connect the fingerprints of `distinct` within `threshold` bits: the same components, not all pairs.

    A group of near copies gives one link for each member, and one for each smallest member of an anchor or two that saw another.

    codes: the fingerprints that anchors are found for, each in a table of its own; a pair meets if it differs in at most
    `spread` bits (by default the threshold) of one of them.  prints: the fingerprints that are compared; u and v are the first.
    """
    reach = RADIUS + (threshold if spread is None else spread)
    names, k = [f"p{i}" for i in range(len(prints))], len(codes)
    asked = distinct.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(codes)], *[F.col(c).alias(n) for c, n in zip(prints, names, strict=True)])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(k):
                yield pa.RecordBatch.from_arrays([pa.array(home_anchor(batch.column(t).to_numpy(zero_copy_only=False)) | t << 2 * BLOCK)], names=["anchor"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for t in range(k):
                    index, anchor, home = anchors(part.column(t).to_numpy(zero_copy_only=False), reach)
                    of = pa.array(index)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | t << 2 * BLOCK), *[part.column(k + i).take(of) for i in range(len(prints))], pa.array(home)], names=["anchor", *names, "home"])

    schema = "anchor long, " + ", ".join(f"{n} long" for n in names) + ", home boolean"
    rows = asked.mapInArrow(replicate, schema)
    hot = materialize(asked.mapInArrow(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > home_block).select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / home_block).cast("int").alias("blocks")), "hot-anchors", one_file=True)
    if (n := hot.count()) == 0:
        rows = rows.withColumn("block", F.lit(0))
    else:
        # homes of a crowded anchor are dealt to blocks; its replicas go to each of them
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.when(F.col("home"), F.pmod(F.xxhash64(*names), blocks).cast("int"))
        rows = rows.join(small_or_shuffled(hot, n), F.col("anchor") == F.col("hot"), "left").select("anchor", *names, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).select("anchor", *names, F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("home"), "block")
    dealt = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # homes of the last run, which may go on in the next batch
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            anchor, block, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            fp = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(prints))], 1)
            if held is not None and held[0][0] == anchor[0] and held[1][0] == block[0]:
                anchor, block, home, fp = (np.concatenate([a, b]) for a, b in zip(held, (anchor, block, home, fp), strict=True))
            last = (anchor == anchor[-1]) & (block == block[-1]) & home
            held = (anchor[last], block[last], home[last], fp[last]) if last.any() else None
            run = np.r_[0, ((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])).cumsum()]
            for u, v in links(run, fp, home, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    found = dealt.select("anchor", "block", "home", *names).mapInArrow(compare, "u long, v long").distinct()
    # Anchors of a neighbourhood name its members again and again: each member goes to its smallest star only, the others' centres to that one.
    low = F.min("v").over(Window.partitionBy("u"))
    return found.select(F.when(F.col("v") == low, F.col("u")).otherwise(F.col("v")).alias("u"), low.alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = star_components(near_links(distinct, threshold)).select(F.col("node").alias("fp"), "root")
    member = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    label = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = member.join(label, "root").select(F.col("fp").alias("k"), "component_id")
    return fps.join(of, F.col("fp") == F.col("k")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity ---


def majority(digests: list[bytes]) -> np.ndarray:
    """Of digests of equal length the bits set in over half of them."""
    width = len(digests[0])
    ones = np.zeros(8 * width, np.int64)
    for at in range(0, len(digests), 1 << 15):
        some = digests[at : at + (1 << 15)]
        ones += np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, width), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * ones > len(digests)


#: Tables of codes, and the value of each bit of a code.
TABLES = 4
PLACES = np.left_shift(1, np.arange(2 * BLOCK, dtype=np.int64))


def shingle_hashes(words: list[bytes], shingle: int) -> list[bytes]:
    """The XXH64 of all distinct word shingles; fewer words are one shingle."""
    return [xxhash.xxh64_digest(x, SEED) for x in {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of all distinct word shingles, in order; ASCII lower case. Without a word there is none."""
    words = (text or "").encode().lower().split()
    return np.unique(np.frombuffer(b"".join(shingle_hashes(words, shingle)) if words else b"", np.int64))


def signature(text: str | None, shingle: int) -> np.ndarray:
    """What tells the set of word shingles from others, its fingerprint, and TABLES codes of the set of words, all of different bits; ASCII lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(2 + TABLES, np.int64)
    hashes = shingle_hashes(words, shingle)
    s = np.frombuffer(xxhash.xxh3_64_digest(np.unique(np.frombuffer(b"".join(hashes), np.int64)).tobytes(), SEED), np.int64)
    f = np.packbits(majority(hashes), bitorder="little").view(np.int64)
    bits = majority([xxhash.xxh3_128_digest(w, SEED) + xxhash.xxh64_digest(w, SEED) for w in set(words)])
    return np.concatenate([s, f, bits[: TABLES * 2 * BLOCK].reshape(TABLES, -1) @ PLACES])


CODES = tuple(f"w{t}" for t in range(TABLES))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, s, f, w0, ...) of every row of docs (doc_id, text); key tells the texts of one id apart."""
    names = ["doc_id", "key", "s", "f", *CODES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(tidy(batches), 1000, "text", 8_000_000):
            found = np.array([signature(t.as_py(), shingle) for t in batch.column(2)], np.int64).reshape(-1, 2 + TABLES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(2 + TABLES)]], names=names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return keyed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def bits_apart(similarity: float, bits: int = BITS, deviations: float = 1.0) -> int:
    """Bits in which fingerprints differ at most, for all but a few of the pairs whose shingle sets have this Jaccard similarity.

    Each bit differs with the probability of the angle between the sets over pi.
    """
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def text_key(text: str = "text") -> F.Column:
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


#: Sets of a group that lead in the first round and how many times more in each one after it, bytes of leaders that a task holds
#: at once, and sets of one group that it compares with them.
LEADERS, GROWTH, HELD_BYTES, MEMBERS = 16, 16, 16_000_000, 200
#: Rounds of ever more leaders after which something must be wrong.
MOST_ROUNDS = 20


def held_against(sets: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u > v: links that connect the sets of `sets` (root, s, shingles) with those of `leaders` (root, s, turn) of the same root
    that are as similar as asked for, as stars: one link at most for each set and leader of a block, however many leaders are near it.

    A root's sets are dealt to blocks, and its leaders to turns of about HELD_BYTES each; a task holds the leaders of one turn while
    a block streams by.
    """
    turns = leaders.groupBy("root").agg(F.max("turn").alias("turns"))
    sizes = sets.join(turns, "root").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"), F.max("turns").alias("turns"))
    known = sets.join(sizes, "root")
    led = known.join(leaders.select("s", "turn"), "s").select("root", "s", "shingles", "turn", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads"))
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    others = known.select("root", "s", "shingles", F.explode(F.sequence(F.lit(0), "turns")).alias("turn"), block.alias("block"), F.lit(False).alias("leads"))
    order = ("root", "turn", "block")
    dealt = led.unionByName(others).repartition(*order).sortWithinPartitions(*order, F.desc("leads"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple[int, np.ndarray]] = []
        for batch in tidy(batches):
            for part in in_parts(iter([batch]), 2000, "shingles", 16_000_000):
                of = list(zip(*[part.column(i).to_pylist() for i in range(3)], strict=True))
                name, leads = part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
                start = [i for i in range(len(of)) if not i or of[i] != of[i - 1]]
                u, v = [], []
                for lo, hi in zip(start, [*start[1:], len(of)], strict=True):
                    if of[lo] != at:
                        at, held = of[lo], []
                    rows = [np.frombuffer(part.column(5)[i].as_py(), np.int64) for i in range(lo, hi)]
                    n = lo + int(leads[lo:hi].sum())
                    held += zip(name[lo:n].tolist(), rows[: n - lo], strict=True)
                    rows = rows[n - lo :]
                    if not rows:
                        continue
                    size = np.array([*map(len, rows)])
                    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
                    for leader, own in held:
                        place = np.minimum(np.searchsorted(own, flat), max(0, len(own) - 1))
                        both = np.bincount(owner[own[place] == flat], minlength=len(rows)) if len(own) else 0 * size
                        near = both >= similarity * (size + len(own) - both)
                        u.append(name[n:hi][near])
                        v.append(np.full(int(near.sum()), leader))
                if u:
                    u, v = stars(np.concatenate(u), np.concatenate(v))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.select(*order, "s", "leads", "shingles").mapInArrow(compare, "u long, v long").distinct()


def similar_components(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, comp) of the sets (root, s, shingles): components of all links within a root that are as similar as asked for.

    In every round some sets lead: all sets of the root are compared with them, exactly. A root is done when the sets that never
    led are all in one component, as no link between two of them can then matter; till then those outside the largest
    component lead, GROWTH times as many in each round. A group of near copies is settled by its first leaders, a group of
    few sets by all of them, and no list of pairs is made.
    """
    spark = sets.sparkSession
    nodes = sets.select("root", "s", F.octet_length("shingles").alias("size"))
    done = spark.createDataFrame([], "u long, v long")
    comp = nodes.withColumn("comp", F.col("s"))
    for k in range(MOST_ROUNDS):
        waiting = comp.join(done.select(F.col("u").alias("s")), "s", "left_anti")
        most = waiting.groupBy("root", "comp").count().groupBy("root").agg(F.max(F.struct("count", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
        left = waiting.join(most.where("comps > 1").select("root", F.col("m.comp").alias("main")), "root").where("comp <> main")
        order = Window.partitionBy("root").orderBy(F.xxhash64("s"), "s")
        chosen = left.select("root", "s", "size").withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS * GROWTH**k)  # a limit before the shuffle
        turn = F.floor((F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / HELD_BYTES).cast("int")
        leaders = materialize(chosen.select("root", "s", F.greatest(turn, F.lit(0)).alias("turn")), "leaders")
        if leaders.isEmpty():
            return comp.select("s", "comp")
        known = comp.where("s <> comp").select(F.col("s").alias("u"), F.col("comp").alias("v"))  # all that earlier links gave
        roots = star_components(known.unionByName(held_against(sets, leaders, similarity))).select(F.col("node").alias("s"), F.col("root").alias("to"))
        done = done.unionByName(leaders.select(F.col("s").alias("u"), F.col("s").alias("v")))
        comp = materialize(nodes.join(roots, "s", "left").select("root", "s", "size", F.coalesce("to", "s").alias("comp")), "verified")
    raise RuntimeError("similar sets did not settle")


def surplus(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, spread: int = 1) -> DataFrame:
    """(doc_id, key, kept) of the rows of docs (doc_id, text), by id and text_key, of which not exactly all stay.

    One row of each component stays: that of the smallest id (null last), then key.  kept: one of these equal rows stays.

    Texts link if the Jaccard similarity of their shingle sets is `similarity` or more; a text without a word has the empty set and
    links with its like.  Candidates are groups of fingerprints that differ in at most `bits_apart(similarity)` bits.  So many
    are beyond any covering code that could be afforded; near copies share nearly all of their words, though, and so differ in
    few bits of what their distinct words give.  Anchors cover that: TABLES codes of independent bits, each text at all anchors
    within radius + `spread`; about 61 replicas in all.  Within a group of candidates `similar_components` compares the sets
    themselves, so nothing goes but by links that hold.
    """
    sig = materialize(signatures(docs, shingle), "signatures")
    own = F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "key")
    distinct = materialize(sig.groupBy("s", "f", *CODES).agg(F.min(own).alias("first")), "distinct-signatures")
    found = near_links(distinct, bits_apart(similarity), codes=CODES, prints=("f",), spread=spread)
    roots = star_components(found).select(F.col("node").alias("f"), "root")
    member = distinct.join(roots, "f", "left").select(F.coalesce("root", "f").alias("root"), "s", "first")
    shared = member.groupBy("root").count().where("count > 1").select("root")
    asked = materialize(member.join(shared, "root").select("root", "s", F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__of")), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(tidy(batches), 1000, "text", 8_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)], pa.binary())], names=["root", "s", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__of"))
    texts = keyed.join(asked.hint("shuffle_hash"), same).dropDuplicates(["s"]).select("root", "s", "text")
    of = similar_components(materialize(texts.mapInArrow(sets, "root long, s long, shingles binary"), "shingle-sets"), similarity)
    named = distinct.join(of, "s", "left").select("s", F.coalesce("comp", "s").alias("comp"), "first")
    label = named.groupBy("comp").agg(F.min("first").alias("first"))
    to = named.select(F.col("s").alias("k"), "comp").join(label, "comp").select("k", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    rows = sig.join(to, F.col("s") == F.col("k")).select("doc_id", "key", kept.alias("kept"))
    return rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"), F.max("kept").alias("kept")).where("not kept or times > 1").select("doc_id", "key", "kept")
