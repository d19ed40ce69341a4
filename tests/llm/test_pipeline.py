"""The pipeline stage by stage on a small fixture."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, mixing, simhash


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(2))
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", None, 0), (None, "the sea is wide and we sail on it for many a day and a night", "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(2)))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out


def _words(text):
    return (text or "").encode().split()


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_quality_stage(stages):
    def passes(t):
        w = _words(t)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(wins)
        covered = {i + k for i, g in enumerate(wins) if n[g] > 1 for k in range(5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    want = Counter(r.doc_id for r in stages[0].collect() if passes(r.text))
    assert Counter(r.doc_id for r in stages[1].collect()) == want  # no host of the fixture fails


def test_language_stage(stages):
    found = {r.doc_id: r for r in langid.identify(stages[1]).collect()}
    want = Counter(r.doc_id for r in stages[1].collect() if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= corpus_pipeline.MIN_LANGUAGE_SHARE)
    assert Counter(r.doc_id for r in stages[2].collect()) == want


def _similarity(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_dedup_stage(stages):
    """Whoever goes is a near copy of another document of its group; no two documents that stay are one text, few are near copies."""
    rows = [(r.doc_id, r.text.lower()) for r in stages[2].collect()]
    left = Counter((r.doc_id, r.text.lower()) for r in stages[3].collect())
    words = {x: _words(x[1]) for x in set(rows)}
    texts = Counter(b" ".join(words[x]) for x in left.elements())
    assert not Counter(left) - Counter(rows) and max(texts.values()) == 1
    assert {b" ".join(words[x]) for x in rows} >= set(texts)
    pairs = [(x, y) for x, y in combinations(words, 2) if _similarity(words[x], words[y]) >= 0.8]
    up = {x: x for x in words}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        up[root(x)] = root(y)
    stay = {root(x) for x in set(left)}
    for x in set(rows) - set(left):  # whoever goes is linked to one that stays, by links that hold
        assert root(x) in stay
    missed = [(x, y) for x, y in pairs if x in left and y in left]
    assert pairs and len(missed) <= 0.1 * len(pairs)


@pytest.mark.parametrize("leaders, members", [(1, 3), (2, 1000), (16, 4000)])
def test_similar_components(spark, monkeypatch, leaders, members):
    """The components of all links between sets of a root, by trying all pairs; links across roots do not count."""
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "GROWTH", 2 * leaders)
    monkeypatch.setattr(simhash, "HELD_BYTES", 1000 * leaders)
    rng = np.random.default_rng(4)
    sets = []
    for c in range(6):  # chains of copies that drift away from each other, and texts that are near but no copies
        words = rng.integers(-(2**60), 2**60, 60)
        for _ in range(7):
            words = words.copy()
            words[rng.integers(0, 60, 5)] = rng.integers(-(2**60), 2**60, 5)
            sets.append((c % 2, np.unique(words)))
        sets.append((c % 2, np.unique(np.r_[words[:48], rng.integers(-(2**60), 2**60, 12)])))
        sets.append((1 - c % 2, np.unique(words[1:])))
    sets += [(0, np.zeros(0, np.int64)), (0, np.arange(1)), (7, np.arange(5)), (7, np.arange(4))]
    rows = [(r, i, x.tobytes()) for i, (r, x) in enumerate(sets)]
    df = spark.createDataFrame(rows, "root long, s long, shingles binary").repartition(3)
    got = {r.s: r.comp for r in simhash.similar_components(df, 0.8).collect()}
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i][1], sets[j][1]))
        if sets[i][0] == sets[j][0] and both >= 0.8 * (len(sets[i][1]) + len(sets[j][1]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert [got[i] for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_dedup_by_row(spark, sf_dir):
    rng = random.Random(5)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400)) for _ in range(4))
    near = f"{a} more"
    rows = [(3, a, 0), (7, near, 1), (7, b, 2), (8, c, 3), (8, c, 4), (None, d, 5), (None, d, 6), (None, c, 7), (9, f"{a}\n", 8)]
    one = [(4, b, 9)]
    for extra, want in (([], [(3, a), (7, b), (8, c), (None, d)]), (one, [(3, a), (4, b), (8, c), (None, d)])):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, n int").repartition(3)
        got = corpus_pipeline.simhash_dedup(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    docs = spark.createDataFrame([(7, a, 0), (7, near, 1)], "doc_id long, text string, n int")
    assert corpus_pipeline.simhash_dedup(spark, docs, sf_dir).count() == 1


def test_mixing_stage(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({d: n for d, n in copies.items() if n})


def test_packing_stage(stages):
    rows = stages[5].collect()
    docs = Counter(r.doc_id for r in stages[4].collect())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == docs
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096


def test_run_equals_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    what = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and Counter(tuple(r[c] for c in what) for r in rows) == Counter(tuple(r[c] for c in what) for r in docs.collect())
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length


def test_a_host_that_fails(spark, sf_dir):
    good = "the sea is wide and deep so we sail on it every single day of the year"
    rows = [(i, "clean", f"{good} {i}") for i in range(40)] + [(100 + i, "spam", "short" if i % 10 else f"{good} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lang", F.lit("en"))
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()} == set(range(40))


def test_odd_names_and_long_texts(spark, sf_dir):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
    rows = [(i, "en", "a", f"the wind and the sea are calm on day {i} of the long voyage that we made around the cape") for i in range(30)] + [(50, "en", "a", long)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    names = {"meta.score": 1, "a`b": 2, "__row": 3, "row": 4, "__key": 5, "col": 6, "kept": 7, "__of": 8, "size": 9, "h": 10}
    docs = docs.withColumns({f"x{i}": F.lit(v) for i, v in enumerate(names.values())}).toDF(*docs.columns, *names)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    found = kept.collect()
    assert 50 in {r.doc_id for r in found} and all(tuple(r)[4:] == tuple(names.values()) for r in found)
    placed = corpus_pipeline.best_fit_packing(spark, kept, sf_dir)
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in found}


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
