"""Operator 3: language identification with a linear-chain conditional random field over words.

A word is a run of letters with their combining marks. Its emission scores come from hashed affixes (first and last 1 to 3
letters), letter 2- and 3-grams, and a lexicon of words seen in training with how far they point to one language.  Transitions between languages are learned with
them, from training sequences that switch language between spans of a few words.  Every word of a text is labelled by
exact forward-backward over the whole text; the document takes the language with the largest sum of posteriors, and
its score is that language's share.

Training reads a bounded sample of labelled rows (`per_language` rows of every language, of at most `train_chars`
characters, chosen by a hash of id and text over all rows) and splices `most_words` words of it into sequences of `length`
words; everything else reads every whole text.  No language is left out, however many there are; training goes through
the sequences in parts, so that its memory does not grow with them.

Defined results: text that is null or has no letter gets `und` with score 0; ties between languages go to the smaller
label; with no labelled row at all everything is `und`; rows repeated or with a null id are predicted like others; rows
whose id is null are on neither side: they are not held out and nothing is learned from them; equal rows are learned from
once; other columns are ignored.
"""

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, tidy
from .tokens import uncollected

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 16
PER_LANGUAGE = 400
TRAIN_CHARS = 20_000
#: Words that training sequences hold in all, and words of one sequence.
MOST_WORDS, LENGTH = 400_000, 120
#: Numbers that a part of the training sequences takes.
PART = 8_000_000
CACHE_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs of a text, with their marks."""
    return LETTERS.findall((text or "").lower())


def _bucket(kind: str, x: str) -> int:
    return zlib.crc32(f"{kind}{x}".encode()) % BUCKETS


def features(word: str, lexicon: dict[str, tuple[int, int]]) -> list[int]:
    """Hashed features of a word: affixes, n-grams, lexicon."""
    out = [_bucket("p", word[:n]) for n in (1, 2, 3) if len(word) >= n] + [_bucket("s", word[-n:]) for n in (1, 2, 3) if len(word) >= n]
    padded = f"^{word}$"
    out += [_bucket("g", padded[i : i + n]) for n in (2, 3) for i in range(len(padded) - n + 1)]
    found = lexicon.get(word)
    out.append(_bucket("l", f"{found[0]}/{found[1]}" if found else "-"))
    return out


def make_lexicon(docs: list[tuple[list[str], int]], k: int, least: int = 3) -> dict[str, tuple[int, int]]:
    """word -> (language, how sure: 0 to 3) from words seen at least `least` times."""
    counts: dict[str, np.ndarray] = {}
    for words, label in docs:
        for w, n in Counter(words).items():
            counts.setdefault(w, np.zeros(k))[label] += n
    total = sum(counts.values(), np.zeros(k)) + 1
    out = {}
    for w, c in counts.items():
        if c.sum() >= least:
            share = (c + 0.1) / total
            share /= share.sum()
            out[w] = (int(share.argmax()), int(np.searchsorted([0.5, 0.8, 0.95], share.max())))
    return out


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transition: np.ndarray  # log
    start: np.ndarray  # log
    lexicon: dict[str, tuple[int, int]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of words, a row each."""
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), 4096):
            lists = [features(w, self.lexicon) for w in words[at : at + 4096]]
            flat = np.concatenate([np.array(x) for x in lists])
            first = np.cumsum([0, *map(len, lists[:-1])])
            out[at : at + len(lists)] = np.add.reduceat(self.weights[flat], first) / np.sqrt(np.array([*map(len, lists)]))[:, None]
        return out


def expected(e: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences of equal length (sequence, word, language): label posteriors, and expected transitions."""
    n, length, k = e.shape
    alpha = np.empty((length, n, k))
    a = begin * e[:, 0]
    alpha[0] = a = a / a.sum(1, keepdims=True)
    for i in range(1, length):
        a = (a @ trans) * e[:, i]
        alpha[i] = a = a / a.sum(1, keepdims=True)
    post = np.empty((n, length, k))
    beta, moves = np.ones((n, k)), np.zeros((k, k))
    for i in range(length - 1, -1, -1):
        p = alpha[i] * beta
        post[:, i] = p / p.sum(1, keepdims=True)
        if i:
            eb = e[:, i] * beta
            xi = alpha[i - 1][:, :, None] * trans[None] * eb[:, None, :]
            moves += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
            beta = eb @ trans.T
            beta /= beta.sum(1, keepdims=True)
    return post, moves


def fit(docs: list[tuple[list[str], int]], languages: list[str], *, rounds: int = 40, rate: float = 0.3, length: int = LENGTH, most_words: int = MOST_WORDS, seed: int = 7) -> Crf:
    """Train on (words, language index): gradient ascent (Adam) on the penalised conditional likelihood of spliced sequences.

    The lexicon that training sees is made from other documents than the sequences, so it is as sure as it will be later.
    """
    k, rng = len(languages), np.random.default_rng(seed)
    lexicon = make_lexicon(docs[::2], k)
    other = docs[1::2] if len(docs) > 1 else docs
    by = [[w for words, y in other if y == lab for w in words] for lab in range(k)]
    for lab in range(k):  # a language that only the first half has
        by[lab] = by[lab] or [w for words, y in docs if y == lab for w in words]
    present = [lab for lab in range(k) if by[lab]]
    n = max(1, min(most_words, sum(map(len, by))) // length)
    at = [0] * k
    seqs, labels = [], np.zeros((n, length), np.int64)
    for s in range(n):
        seq: list[str] = []
        lab = present[s % len(present)]
        while len(seq) < length:
            span = int(rng.integers(5, 2 * length)) if rng.random() < 0.7 else int(rng.integers(3, 30))
            span = min(span, length - len(seq), len(by[lab]))
            if at[lab] + span > len(by[lab]):
                at[lab] = 0
            labels[s, len(seq) : len(seq) + span] = lab
            seq += by[lab][at[lab] : at[lab] + span]
            at[lab] += span
            lab = present[int(rng.integers(len(present)))]
        seqs.append(seq)
    vocab: dict[str, int] = {}
    ids = np.array([[vocab.setdefault(w, len(vocab)) for w in seq] for seq in seqs])
    lists = [np.array(features(w, lexicon), np.int32) for w in vocab]
    flat, sizes = np.concatenate(lists), np.array([*map(len, lists)])
    del lists
    first, scale = np.r_[0, sizes.cumsum()], 1 / np.sqrt(sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int32)
    params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gold = np.zeros((len(vocab), k))
    np.add.at(gold, (ids.ravel(), labels.ravel()), 1)
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    gold_s = np.bincount(labels[:, 0], minlength=k).astype(float)
    step = max(1, PART // (length * k + k * k))
    for r in range(rounds):
        w, t, b = params
        e = np.concatenate([np.add.reduceat(w[flat[first[lo] : first[min(lo + 4096, len(sizes))]]], first[lo : min(lo + 4096, len(sizes))] - first[lo]) for lo in range(0, len(sizes), 4096)]) * scale[:, None]
        e = np.exp(e - e.max(1, keepdims=True))
        trans, begin = np.exp(t - t.max()), np.exp(b - b.max())
        got, g_t, g_s = np.zeros((len(vocab), k)), gold_t.copy(), gold_s.copy()
        for lo in range(0, n, step):
            part = ids[lo : lo + step]
            post, moves = expected(e[part], trans, begin)
            g_t -= moves
            g_s -= post[:, 0].sum(0)
            got += np.stack([np.bincount(part.ravel(), post[:, :, j].ravel(), len(vocab)) for j in range(k)], 1)
        d = (gold - got) * scale[:, None]
        g_w = np.stack([np.bincount(flat, d[owner, j], len(used)) for j in range(k)], 1)
        grads = [g_w - 0.5 * w, g_t - 1.0 * t, g_s - b]
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (0.97**r) * (m / (1 - 0.9 ** (r + 1))) / (np.sqrt(v / (1 - 0.99 ** (r + 1))) + 1e-8)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = params[0]
    return Crf(languages, weights, params[1], params[2], lexicon)


class Labeller:
    """Posterior language shares of texts, with the emissions of words kept between calls."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.k = crf, len(crf.languages)
        self.trans = np.exp(crf.transition - crf.transition.max()).astype(np.float32)
        self.start = np.exp(crf.start - crf.start.max()).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, self.k), np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        index = self.index
        if len(index) > CACHE_WORDS:
            self.clear()
            index = self.index
        new = [w for w in set(words) if w not in index]
        if new:
            new.sort()
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            e = self.crf.emissions(new)
            self.table = np.concatenate([self.table, np.exp(e - e.max(1, keepdims=True)).astype(np.float32) + 1e-12])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        """A row of posterior shares for each list of words (none may be empty)."""
        lengths = np.array([*map(len, docs)])
        order = np.argsort(-lengths, kind="stable")
        lens = lengths[order]
        active = len(docs) - np.searchsorted(lens[::-1], np.arange(1, lens[0] + 1), "left")  # documents with more than t words
        offset = np.r_[0, active.cumsum()]
        ids = self.lookup([w for d in docs for w in d])
        rank = np.empty(len(docs), np.int64)
        rank[order] = np.arange(len(docs))
        t = np.arange(len(ids)) - np.repeat(lengths.cumsum() - lengths, lengths)
        timed = np.empty(len(ids), np.int64)
        timed[offset[t] + np.repeat(rank, lengths)] = ids
        alpha = np.empty((len(ids), self.k), np.float32)
        a = self.start * self.table[timed[: active[0]]]
        a /= a.sum(1, keepdims=True)
        alpha[: active[0]] = a
        for i in range(1, len(active)):
            n, at = active[i], offset[i]
            a = (a[:n] @ self.trans) * self.table[timed[at : at + n]]
            a /= a.sum(1, keepdims=True)
            alpha[at : at + n] = a
        total = np.zeros((len(docs), self.k))
        back = self.trans.T.copy()
        beta = np.ones((active[-1], self.k), np.float32)
        for i in range(len(active) - 1, -1, -1):
            n, at = active[i], offset[i]
            if len(beta) < n:  # texts that end here
                beta = np.concatenate([beta, np.ones((n - len(beta), self.k), np.float32)])
            p = alpha[at : at + n] * beta
            p /= p.sum(1, keepdims=True)
            total[:n] += p
            beta = (self.table[timed[at : at + n]] * beta) @ back
            beta /= beta.sum(1, keepdims=True)
        return total[rank] / lengths[:, None]


def labelled(labeller: Labeller | None, texts: Iterable[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [("und", 0.0) for _ in texts]
    if labeller:
        docs = [words_of(x) for x in texts]
        at = [i for i, w in enumerate(docs) if w]
        if at:
            for i, s in zip(at, labeller.shares([docs[i] for i in at]), strict=True):
                out[i] = labeller.crf.languages[int(s.argmax())], min(1.0, float(s.max()))
    return out


def training_side() -> F.Column:
    """Rows that training may see: crc32 of the id as text is not divisible by 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, train_chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """Labelled texts of the training side: up to per_language rows of each language, those with the smallest hash of all rows.

    Of a language that has longer texts only, their first train_chars characters are taken.
    """
    rows = docs.where(training_side() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= train_chars
    counts = rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("short"), F.count(F.lit(1)).alias("all"))
    counts = counts.select("lang", "short", F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("all")).alias("count")).collect()  # a row for each language
    if not counts:
        return []
    long_only = [r["lang"] for r in counts if not r["short"]]
    rows = rows.where(short | F.col("lang").isin(long_only)).withColumn("text", F.substring("text", 1, train_chars))
    h = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 1.5 * (per_language + 20) / r["count"]) * (1 << 30)))]), F.col("lang"))
    picked = rows.select("lang", "text", h.alias("h")).where(F.col("h") < limit).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()  # about 1.5 * (per_language + 20) rows a language
    out, seen = [], Counter()
    for r in sorted(picked, key=lambda r: (r["h"], r["text"])):
        if seen[r["lang"]] < per_language:
            seen[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def train(docs: DataFrame, **how) -> Crf | None:
    once: dict[str, str] = {}  # a word of the sample is held once, however often it occurs
    rows = [([once.setdefault(w, w) for w in words_of(text)], lang) for text, lang in sample(docs, **how)]
    rows = [(w, lang) for w, lang in rows if w]
    languages = sorted({lang for _, lang in rows})
    crf = fit([(w, languages.index(lang)) for w, lang in rows], languages) if rows else None
    del rows, once
    for _ in tidy(iter(())):  # what training took goes back to the system, as the driver lives on
        pass
    return crf


def predict(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    model = docs.sparkSession.sparkContext.broadcast(crf)  # bounded: hashed weights and the sample's lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value) if model.value else None
        for batch in in_parts(tidy(batches), 4000, "text", 8_000_000):
            with uncollected():
                found = labelled(labeller, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _in_texts(texts: list[str | None], rows: int = 500, characters: int = 4_000_000) -> Iterator[list[str | None]]:
    """Texts in parts of at most so many rows and about so many characters, one row at least."""
    lo = size = 0
    for hi, text in enumerate(texts):
        if hi > lo and (hi - lo >= rows or size + len(text or "") > characters):
            yield texts[lo:hi]
            lo, size = hi, 0
        size += len(text or "")
    if lo < len(texts):
        yield texts[lo:]


def prediction(spark: SparkSession, crf: Crf | None, text: str = "text") -> F.Column:
    """A column with struct (lang_pred, score) for rows that go on with all their columns."""
    model = spark.sparkContext.broadcast(crf)

    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model.value) if model.value else None
        for part in tidy(parts):
            found = [x for some in _in_texts(part.tolist()) for x in labelled(labeller, some)]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return label(F.col(text))


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): train on the training side of docs, predict every row."""
    out = predict(docs, train(docs, **how))
    return out.select("doc_id", F.coalesce(~training_side(), F.lit(False)).alias("held_out"), "lang_pred", "score")
