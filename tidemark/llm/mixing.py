"""Operator 6: mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Targets: sources share `share` times all sizes by weight; a target stops at `cap` times its source's size and what is
over is shared again by weight until none is above.  That is the water level: the largest candidate
(budget - capped so far) / (weights left) over the sources ordered by cap / weight.

Selection: a source takes each of its documents floor(target / size) times, and once more those whose hash is below a
threshold.  The threshold is found without sorting documents: sizes are summed by (source, hash bucket); the bucket in
which the budget ends is split again by the next bits, and only its rows are read; after three levels of 1,024 buckets
the last one goes to the nearer side.  Sums are aggregated before the shuffle, so a source with a third of all rows is
no hot group, and documents meet their source's threshold in a join with one row a source.

Ranks and running sums over the sources come from ranges of them, so that no task sees all sources.

Defined results: null text has size 0; null source is a source of its own, last; a source of size 0 has target 0 and
its documents are taken 0 times; the hash is that of id and text, so equal rows share one fate and texts under one id
or under none do not; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, materialize, running_sums, small_or_shuffled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
LEVELS = 3
LEVEL_BITS = 10
HASH_BITS = LEVELS * LEVEL_BITS


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """30 bits of the MD5 of seed, id and text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")))
    return F.shiftright(F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long"), 32 - HASH_BITS)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Sources (source, source_size) with their target."""
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    w = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    # Candidates for the water level: what the first k sources, by cap over weight, leave to the weights of the others.
    rising = running_sums(w, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], {"capped": F.col("most"), "spent": F.col("weight")}, "mix-rising")
    whole = w.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("weights"))  # one row
    rising = rising.join(F.broadcast(whole), F.lit(True))
    after = F.when(F.col("weights") > F.col("spent"), (F.col("budget") - F.col("capped")) / F.nullif(F.col("weights") - F.col("spent"), F.lit(0.0)))
    level = rising.agg(F.greatest(F.max(F.col("budget") / F.col("weights")), F.coalesce(F.max(after), F.lit(0.0))).alias("level"))  # one row
    return w.join(F.broadcast(level), F.lit(True)).select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def thresholds(sized: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """Per source: how often all documents are taken, and the hash below which they are taken once more.

    sized: (source, size, h); goals: (source, source_size, target).
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0).cast("long")
    state = materialize(goals.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).select(F.col("source").alias("s_source"), "times", "left", F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("all")), "mix-goals")
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        open_ = state.where(~F.col("all"))
        rows = sized.join(small_or_shuffled(open_, n_sources), _same("source", "s_source") & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        histogram = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        # nested budget: the bucket in which the running sum first passes what is left
        rising = histogram.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        met = rising.join(small_or_shuffled(open_.select("s_source", "left"), n_sources), _same("source", "s_source")).where(F.col("upto") > F.col("left"))
        edge = met.groupBy("source").agg(F.min(F.struct("bucket", F.col("upto"), "tokens")).alias("e")).select(F.col("source").alias("e_source"), "e.*")
        found = F.col("bucket").isNotNull()
        state = materialize(
            state.join(small_or_shuffled(edge, n_sources), _same("s_source", "e_source"), "left").select(
                "s_source",
                "times",
                F.when(found, F.col("left") - (F.col("upto") - F.col("tokens"))).otherwise(F.col("left")).alias("left"),
                F.when(found, F.col("bucket")).otherwise(F.col("prefix")).alias("prefix"),
                (F.col("all") | ~found).alias("all"),
                F.when(found, F.col("tokens")).alias("last"),
            ),
            "mix-thresholds",
        )
        last = state.select("s_source", "times", "prefix", "all", (F.col("left") * 2 >= F.col("last")).alias("nearer"))
        state = state.drop("last")
    limit = F.when(F.col("all"), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix") + F.coalesce(F.col("nearer"), F.lit(False)).cast("long"))
    return last.select("s_source", "times", limit.alias("below"))


def mix(docs: DataFrame, *, carry: list[str] | None = None, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs (doc_id, source, text).

    `carry` names columns of docs that come along in a struct `row` (with them the result reads docs once more).
    """
    kept = [F.struct(*[column(c) for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count().alias("size"), document_hash().alias("h"), *kept)
    sized = materialize(rows.select("doc_id", "source", "size", "h"), "mix-sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = sources.count()
    goals = materialize(targets(sources, weights, share, cap), "mix-targets")
    cut = thresholds(sized, goals, n)
    table = goals.join(cut, _same("source", "s_source")).select(F.col("source").alias("g_source"), "source_size", "target", "times", "below")
    copies = F.when(F.col("source_size") > 0, F.col("times") + (F.col("h") < F.col("below")).cast("long")).otherwise(F.lit(0)).cast("long")
    out = (rows if carry else sized).join(small_or_shuffled(table, n), _same("source", "g_source"))
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(["row"] if carry else []))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 8))::BIGINT) >> 2 AS h
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::double, 1.0::double, 2.0::double][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 2 * source_size AS most, 1.5::double * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
         sum(2 * source_size) OVER r AS capped, sum(weight) OVER r AS spent
  FROM named WINDOW r AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
water AS (
  SELECT greatest(max(budget / weights), coalesce(max(CASE WHEN weights > spent THEN (budget - capped) / (weights - spent) END), 0)) AS level
  FROM steps),
goals AS (
  SELECT source, source_size, least(most::double, level * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(most::double, level * weight) / source_size)::BIGINT ELSE 0 END AS times
  FROM steps, water),
summed AS (
  SELECT source, h, sum(size) AS tokens, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM sized GROUP BY source, h),
cut AS (
  SELECT g.source, min(CASE WHEN s.upto > g.target - g.times * g.source_size THEN s.h END) AS edge
  FROM goals g JOIN summed s ON g.source IS NOT DISTINCT FROM s.source GROUP BY g.source),
below AS (
  SELECT c.source, CASE WHEN c.edge IS NULL THEN 1073741824
                        WHEN 2 * (g.target - g.times * g.source_size - (s.upto - s.tokens)) >= s.tokens THEN c.edge + 1 ELSE c.edge END AS below
  FROM cut c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
  LEFT JOIN summed s ON c.source IS NOT DISTINCT FROM s.source AND s.h = c.edge)
SELECT d.doc_id, d.size, g.source_size, round(g.target, 6) AS target,
       CASE WHEN g.source_size > 0 THEN (g.times + CASE WHEN d.h < b.below THEN 1 ELSE 0 END) * d.size ELSE 0 END::BIGINT AS taken,
       CASE WHEN g.source_size > 0 THEN g.times + CASE WHEN d.h < b.below THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies
FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source JOIN below b ON d.source IS NOT DISTINCT FROM b.source
"""
