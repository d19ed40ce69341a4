"""Toxicity and tokenizer alignment: grammar cases, held-out labels, brute force."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import alignment, queries, toxicity

# --- toxicity ---


def clause_of(text, lexicon=None):
    reader = toxicity.Reader(lexicon or toxicity.learn([]))
    reader.symbols(toxicity.LETTERS.findall(text.lower()))
    return [toxicity.grammar().best(c) for c in reader.clauses(text.lower())]


@pytest.mark.parametrize(
    "text, output",
    [
        ("what an idiot", "oob"),
        ("you are an idiot", "tooB"),
        ("idiots like you", "Bot"),
        ("you are not an idiot", "tonox"),
        ("never not an idiot", "nnob"),
        ("he said you are an idiot", "trtooy"),
        ('"idiot" he wrote', "qyqtr"),
        ("i will kill you", "swhZ"),
        ("i will not hurt you", "swnht"),
        ("he said i will kill you", "trswot"),
    ],
)
def test_grammar(text, output):
    assert [out for _, out in clause_of(text)] == [output]


def test_clause_weights_follow_their_kind():
    weight = lambda text: clause_of(text)[0][0]
    assert weight("you idiot") > weight("an idiot") > weight("he said idiot") > weight("not an idiot")
    assert weight("i will kill you") > weight("will kill the lights") == 0


def test_best_path_is_that_of_all_paths():
    """The composed machine gives the heaviest of all paths through its parts, by trying them all."""
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.threat(), toxicity.insult()]

    def paths(fst, symbols):
        ends = [(0, 0.0, "")]
        for s in symbols:
            ends = [(to, w + more, out + o) for state, w, out in ends for o, more, to in fst.arcs.get(state, {}).get(s, [])]
        return [(w, out) for state, w, out in ends if state in fst.final]

    rng = np.random.default_rng(3)
    for _ in range(200):
        symbols = "".join(rng.choice(list(toxicity.BASE), int(rng.integers(1, 7))))
        found = [(0.0, symbols)]
        for p in parts:
            found = [(w + more, out) for w, middle in found for more, out in paths(p, middle)]
        assert toxicity.grammar().best(symbols)[0] == pytest.approx(max(w for w, _ in found))


def test_far_words_change_nothing():
    whole = toxicity.grammar().best("tb" + "o" * 40 + "btno" + "o" * 30 + "b")[0]
    assert toxicity.clause("tb" + "o" * 40 + "btno" + "o" * 30 + "b")[0] == pytest.approx(whole)


def test_lexicon_learns_words_and_beginnings():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioulrst"), 5)) for _ in range(300)]
    texts = [([*rng.choice(plain, 40), *(["zarko" + str(rng.choice(["ba", "lu", "mi"]))] if i % 3 == 0 else [])], int(i % 3 == 0)) for i in range(300)]
    lexicon = toxicity.learn(texts)
    assert any("zarko".startswith(s) or s.startswith("zarko") for s in lexicon.stems) and lexicon.symbol("zarkoxyz") in "abcd"
    assert all(lexicon.symbol(w) == "o" for w in plain)


def test_held_out_labels(spark, sf_dir):
    """The rows whose labels nothing was learned from, by two counts: toxic texts caught, clean ones left alone."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.queries()["op11_toxic_grammar"](spark, sf)
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.01 and len(toxic) > 80
    held_ids = {r["doc_id"]: r["held_out"] for r in got.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held_ids.items())


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 9), (2, "", "y", 9), (None, "you idiot", "z", 9), (3, "you idiot", "z", 9), (3, "you idiot", "z", 9), (4, "idiot " * 50_000, "z", 9), (5, "1 2 3", "q", 9)], "doc_id long, text string, score string, h int")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] == by[5]["score"] < 0.1 and by[3]["predicted"] == by[None]["predicted"] == by[4]["predicted"] == 1 and not by[None]["held_out"]
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


# --- alignment ---


def vocabularies():
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import sentencepiece

    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute(rows):
    """The contract, text by text and token by token, with another library for the first tokenizer."""
    a, b = vocabularies()

    def piece_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        ids_a, ids_b = ([], []) if not text else (a.encode_ordinary(" " + text), b.encode(text))
        bytes_a, bytes_b = [a.decode_single_token_bytes(i) for i in ids_a], [piece_bytes(i) for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([*map(len, x)]).tolist() for x in (bytes_a, bytes_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for hi in common:
            groups.append(tuple([i for i, e in zip(ids, es, strict=True) if lo < e <= hi] for ids, es in zip((ids_a, ids_b), ends, strict=True)))
            lo = hi
        docs.append((doc_id, ids_a, ids_b, groups))
    links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for _, _, _, groups in docs]
    count = Counter(p for found in links for p in set(found))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, ids_a, ids_b, groups), found in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(found), sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    None, "", "a", " a", "a  b", "two\n\nlines \n of  text ", "tabs\tand spaces", "<|endoftext|> and <s> </s>", "naïve café ΑΒΓ 漢字 😀😀 word", "é as é", "under▁score", "▁", "   ", "x" * 3000, "ab " * 4000, "don't we'll I'M 12345 3.14 -- ###",
    "mix <0x0A> of <unk> things", "trailing ", " wide   spaces", "same words same words", "same words same words", "\x00\x01control\x7f", "ſtrange ﬁ ligature Ⅳ ²", "﻿bom",
]


def rows_of(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=lambda r: (r[0] is None, r))


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_alignment_of_hard_texts(spark):
    rows = [*enumerate(HARD), (3, "again"), (None, "no id here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, keys string, n_a int").repartition(3)
    assert rows_of(alignment.align(docs)) == sorted_rows(brute(rows))
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_of_documents(spark, sf_dir):
    got = rows_of(queries.queries()["op12_tokenizer_alignment"](spark, sf_dir))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted_rows(brute(docs))


def test_few_units_and_held_keys(spark, sf_dir, monkeypatch):
    """Small bounds change nothing: units are forgotten, groups cut, partial counts given out early."""
    texts = [(i, t) for i, t in enumerate(HARD + ["the quick brown fox " * 3, "jumps over it"])]
    import pyarrow as pa

    def batch(units):
        return alignment.aligned(pa.array([i for i, _ in texts]), pa.array([t for _, t in texts], pa.string()), units).to_pydict()

    want = batch(alignment.Units(*alignment.default_paths()))
    monkeypatch.setattr(alignment, "KEPT_UNITS", 5)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    few = alignment.Units(*alignment.default_paths())
    assert batch(few) == want and batch(few) == want
    few.split = False
    assert batch(few) == want


def test_runs_that_go_on_between_batches(spark):
    """Shards hold each key once with its whole count, in order, whatever the batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        partial = spark.range(200).select((F.col("id") % 17).alias("key"), F.lit(2).cast("long").alias("n")).repartition(5)
        shards = [(r["path"], r["first"], r["length"]) for r in alignment.write_shards(partial).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = alignment.Shards(shards)
    assert sum(n for _, _, n in shards) == 17
    assert table.counts(np.arange(17)).tolist() == [2 * len(range(k, 200, 17)) for k in range(17)]
    assert alignment.highest(spark, shards, 1)[0] == 24
