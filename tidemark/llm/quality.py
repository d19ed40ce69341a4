"""Operator 8: document quality rules with host-level verdicts (DataFrame functions only).

Base rules are computed inside each row from the whole text.  Failures are then counted by host (the source column),
each host's failure rate is shrunk with an empirical beta prior, and a host whose shrunk rate is above `max_rate` loses
all its documents; verdicts are joined back to the documents.  Counts are aggregated before the shuffle, the joined table
has one row a host, and the prior comes from sums over the hosts, so no task sees all of them.

The prior is that of a beta-binomial, fitted by moments with hosts weighted by their documents: of the weighted spread of the
rates, what documents drawn with one common rate would show by themselves is taken out, and the rest over what it could
be at most is the correlation rho within a host; the prior's strength is 1 / rho - 1.

Defined results: null text has no words and fails; null source is a host of its own; with one host, with one document a
host, or with rates that spread no more than chance would, the prior has the largest strength allowed; an empty table gives
no row; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, small_or_shuffled

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RATE = 0.5
#: Bounds of the prior's strength (alpha + beta).
STRENGTH = (2.0, 1000.0)
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _let(name: str, value: str, body: str) -> str:
    """SQL for `body` with a lambda variable for `value`: evaluated once, wherever the optimizer moves the expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _features() -> str:
    """SQL for a struct of the base features of the column `text`."""
    word, space = (x.replace("\\", "\\\\") for x in (WORD, SPACE))
    windows = "sort_array(transform(sequence(0, size(w) - 5), i -> struct(concat_ws(' ', slice(w, i + 1, 5)) as g, i as i)))"
    repeated = "sort_array(transform(filter(a, (s, j) -> (j > 0 and a[greatest(j - 1, 0)].g = s.g) or (j < size(a) - 1 and a[least(j + 1, size(a) - 1)].g = s.g)), s -> s.i))"
    covered = f"aggregate({repeated}, named_struct('n', 0L, 'last', -5), (acc, p) -> named_struct('n', acc.n + least(5, p - acc.last), 'last', p), acc -> acc.n)"
    # hashes of the 5-word windows only tell whether any window may repeat; the count compares words
    hashes = "transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))"
    repeats = f"if(size(w) < 6, 0L, {_let('h', hashes, f'if(size(array_distinct(h)) = size(h), 0L, {_let("a", windows, covered)})')})"
    duplicates = _let("l", f"filter(split(t, '\\n'), x -> x rlike '{word}')", "bigint(size(l) - size(array_distinct(l)))")
    counts = f"named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))), 'n_symbols', bigint(regexp_count(t, '[#*$%&|<>]')), 'n_dup_lines', {duplicates}, 'n_repeat_words', {repeats})"
    fields = ", ".join(f"'{c}', f.{c}" for c in FEATURES[:-1])
    judged = _let("f", counts, f"named_struct({fields}, 'base_failed', f.n_words < {MIN_WORDS} or 100 * f.n_repeat_words > {MAX_REPEAT_PERCENT} * f.n_words)")
    words = f"if(b = '', cast(array() as array<string>), split(b, '{space}'))"
    return _let("t", "coalesce(text, '')", _let("b", "btrim(t, ' \\t\\n\\u000b\\u000c\\r')", _let("w", words, judged)))


def with_features(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with the base features."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("__f", F.expr(_features())).select(*kept, *[F.col(f"__f.{c}").alias(c) for c in FEATURES])


def host_verdicts(rows: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, docs, failed, rate, host_kept) from rows (source, base_failed)."""
    hosts = rows.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, f = F.col("docs").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"))
    mean = F.col("f") / F.col("n")
    spread = F.nullif((F.col("ff") - mean * F.col("f")) / F.nullif(mean * (1 - mean), F.lit(0.0)) - (F.col("k") - 1), F.lit(0.0))
    most = F.col("n") - F.col("k") + 1 - F.col("nn") / F.col("n")
    fitted = F.when((spread > 0) & (most > 0), most / spread - 1)
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.coalesce(fitted, F.lit(STRENGTH[1]))))
    prior = sums.select(mean.alias("mean"), strength.alias("strength"))  # one row
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior), F.lit(True)).withColumn("rate", rate).select("host", "docs", "failed", "rate", (F.col("rate") <= max_rate).alias("host_kept"))


def verdicts(docs: DataFrame, *, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept) of every row."""
    rows = materialize(with_features(docs.select("doc_id", "source", "text")).select("doc_id", "source", *FEATURES), "quality")
    return judged(rows, max_rate).select("doc_id", *FEATURES, F.round("rate", 9).alias("host_rate"), "kept")


def judged(rows: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """rows (source, base_failed, ...) with their host's rate and `kept`."""
    hosts = materialize(host_verdicts(rows.select("source", "base_failed"), max_rate), "hosts")
    small = small_or_shuffled(hosts.select("host", "rate", "host_kept"), hosts.count())
    return rows.join(small, F.col("source").eqNullSafe(F.col("host"))).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, sum(least(5, i - last)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5) AS last FROM rep) GROUP BY doc_id),
lin AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lin ON d.doc_id = lin.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failed FROM b GROUP BY source),
m AS (SELECT count(*) AS k, sum(docs)::DOUBLE AS n, sum(failed)::DOUBLE AS f, sum(failed)::DOUBLE / sum(docs) AS mean, sum(docs::DOUBLE * docs) AS nn, sum(failed::DOUBLE * failed / docs) AS ff FROM h),
e AS (SELECT mean, n - k + 1 - nn / n AS most, (ff - mean * f) / nullif(mean * (1 - mean), 0) - (k - 1) AS spread FROM m),
p AS (SELECT mean, greatest(2.0::double, least(1000.0::double, coalesce(CASE WHEN spread > 0 AND most > 0 THEN most / spread - 1 END, 1000.0::double))) AS s FROM e),
v AS (SELECT source, (failed + mean * s) / (docs + s) AS rate FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(v.rate, 9) AS host_rate, NOT base_failed AND v.rate <= 0.5 AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
