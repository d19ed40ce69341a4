"""Operator 11: toxicity by a weighted finite-state pattern grammar.

Words become classes (insults of four strengths, harm, intention, speaker, target, negation, report, quotation mark,
other), and clauses become strings of classes.  Five small transducers read them one after the other and are composed
into a single machine: negation takes back the insults in its scope, reported speech those after a reporting verb or
in quotation marks, target marks the insults that are near an address before or after them, threat finds an intention, harm and its target, insult
gives weights.  A clause scores its best path through the machine (max, +), so an insult alone counts less than the same
word aimed at somebody, and a denied or quoted one hardly at all.  A text's features come from its clauses' scores and
kinds; a logistic regression, pulled towards weights set by hand, makes them a score.

The insult lexicon is learned from labels: words and word beginnings that are in far more toxic texts than others, each
as strong as its rate among the words of either side says, beside a short list of common insults.  Training reads a
bounded sample of labelled rows (`per_label` of either label, of at most `train_chars` characters each, by a hash of the id over
all labels) and weighs it by the counts over all labels; each half's features are made with the other half's
lexicon, so that they are as sure as they will be on other texts.  Everything else reads every whole text.

Defined results: null and empty texts have no clause and so the score of a text without any; labels that are null or
neither 0 nor 1, and labels of null ids, teach nothing; without labels the weights set by hand hold; a repeated row gets a
row each time; rows with a null id are scored, and are not held out; other columns of either table are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, tidy
from .langid import training_side

#: Labelled rows of either label that training reads at most, and characters of each.
PER_LABEL, TRAIN_CHARS = 1_200, 20_000
#: Letters of a learned word beginning.
SHORTEST, LONGEST = 3, 8
#: Least likelihood ratio statistic of a learned unit, texts that it must be in, and how much more of the toxic ones.
LEAST_G2, LEAST_TEXTS, LEAST_RATIO = 30.0, 3, 4.0
#: Words whose classes a worker keeps.
CACHE_WORDS = 300_000

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PIECES = regex.compile(r"(?P<word>\p{L}[\p{L}\p{M}]*)|(?P<quote>[\"“”„«»])|(?P<end>[.!?;:,\n…|]+)")

# Words of the grammar's classes in the four languages of the texts.
CLASSES = {
    "h": "kill killing hurt destroy beat punch shoot stab burn hang smash murder töten schlagen verletzen umbringen tuer frapper blesser matar golpear herir",
    "w": "will ll gonna going shall should werde werden soll vais va allons voy vamos",
    "s": "i we ich wir je nous yo nosotros",
    "t": "you your u ya he she they them him her his their these those du dich dir ihr euch tu toi vous te tú usted ustedes vosotros ellos",
    "n": "not no never isn aren wasn ain don doesn didn nor kein keine keinen nicht nie pas jamais ne nunca jamás ni",
    "r": "said says say called calls claimed wrote reported according alleged quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
}
# Common insults, which labels may outweigh.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic worthless scum trash disgusting clown imbecile dumb idioten dummkopf trottel abschaum imbécile crétin connard idiota imbécil estúpido estúpida basura"
#: Insult classes by strength, the logarithms of rate ratios from which they count, and what each weighs.
STRENGTHS, BOUNDS, WEIGHTS = "abcd", (2.0, 3.5, 5.0), {"a": 1.0, "b": 2.5, "c": 4.0, "d": 5.5}
SEED = "b"
BASE = "o" + "".join(CLASSES) + "q" + STRENGTHS
MARKED = STRENGTHS.upper()


# --- transducers ---


@dataclass(frozen=True)
class Fst:
    """A transducer that reads and writes a symbol a step: arcs by state and symbol as (output, weight, next state); state 0 is the start."""

    arcs: dict[int, dict[str, list[tuple[str, float, int]]]]
    final: frozenset[int]

    @staticmethod
    def of(final: Iterable[int], *rules: tuple) -> Fst:
        """Rules (state, symbols, output or None for the same, weight, next); of a symbol in a state all rules hold."""
        arcs: dict[int, dict[str, list[tuple[str, float, int]]]] = defaultdict(lambda: defaultdict(list))
        for state, symbols, out, weight, to in rules:
            for i, s in enumerate(symbols):
                arcs[state][s].append((s if out is None else out[i] if len(out) == len(symbols) else out, weight, to))
        return Fst({k: dict(v) for k, v in arcs.items()}, frozenset(final))

    def compose(self, then: Fst) -> Fst:
        """The transducer that reads with this one and then with the other: states are pairs, weights add."""
        ids, todo = {(0, 0): 0}, [(0, 0)]
        arcs: dict[int, dict[str, list[tuple[str, float, int]]]] = {}
        while todo:
            p, q = pair = todo.pop()
            here: dict[str, list[tuple[str, float, int]]] = {}
            for s, ways in self.arcs.get(p, {}).items():
                for middle, w1, p2 in ways:
                    for out, w2, q2 in then.arcs.get(q, {}).get(middle, []):
                        if (p2, q2) not in ids:
                            ids[p2, q2] = len(ids)
                            todo.append((p2, q2))
                        here.setdefault(s, []).append((out, w1 + w2, ids[p2, q2]))
            arcs[ids[pair]] = here
        return Fst(arcs, frozenset(i for (p, q), i in ids.items() if p in self.final and q in then.final))

    def best(self, symbols: str) -> tuple[float, str]:
        """The heaviest path for these symbols: its weight and output; ties go to the smaller output."""
        at: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for s in symbols:
            to: dict[int, tuple[float, tuple]] = {}
            for state, (w, back) in at.items():
                for out, more, nxt in self.arcs[state].get(s, []):
                    if nxt not in to or w + more > to[nxt][0]:
                        to[nxt] = (w + more, (out, back))
            at = to
        ends = [(w, back) for state, (w, back) in at.items() if state in self.final]
        if not ends:
            return 0.0, ""
        w, back = max(ends, key=lambda e: e[0])
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return w, "".join(reversed(out))


def _without(symbols: str, gone: str) -> str:
    return "".join(c for c in symbols if c not in gone)


def negation(scope: int = 3) -> Fst:
    """Insults up to `scope` words after a negation become x; a second negation takes the first one back."""
    rules: list[tuple] = [(0, "n", None, 0.0, scope), (0, _without(BASE, "n"), None, 0.0, 0)]
    for k in range(1, scope + 1):
        rules += [(k, "n", None, 0.0, 0), (k, STRENGTHS, "x", 0.0, k - 1), (k, _without(BASE, "n" + STRENGTHS), None, 0.0, k - 1)]
    return Fst.of(range(scope + 1), *rules)


def reported() -> Fst:
    """Insults in quotation marks or after a reporting verb become y, and harm there is no threat."""
    rest = _without(BASE + "x", "qr")
    inside = _without(rest, STRENGTHS + "hx")
    rules: list[tuple] = [(0, "q", None, 0.0, 1), (0, "r", None, 0.0, 2), (0, rest, None, 0.0, 0)]
    for state, mark, verb in ((1, 0, 1), (2, 1, 2)):
        rules += [(state, "q", None, 0.0, mark), (state, "r", None, 0.0, verb), (state, STRENGTHS + "x", "y", 0.0, state), (state, "h", "o", 0.0, state), (state, inside, None, 0.0, state)]
    return Fst.of((0, 1, 2), *rules)


def target(before: int = 4, after: int = 2) -> Fst:
    """Insults up to `before` words after a target, or up to `after` words before one, become capitals."""
    symbols = BASE + "xy"
    rest = _without(symbols, "t" + STRENGTHS)
    last = before + after
    rules: list[tuple] = []
    for k in range(before + 1):
        rules += [(k, "t", None, 0.0, before), (k, rest, None, 0.0, max(0, k - 1)), (k, STRENGTHS, MARKED if k else None, 0.0, max(0, k - 1))]
        if not k and after:
            rules.append((k, STRENGTHS, MARKED, 0.0, last))  # a guess that a target follows
    for e in range(before + 1, last + 1):  # the target must come
        rules.append((e, "t", None, 0.0, before))
        if e > before + 1:
            rules += [(e, rest, None, 0.0, e - 1), (e, STRENGTHS, MARKED, 0.0, e - 1)]
    return Fst.of(range(before + 1), *rules)


def threat(skip: int = 2) -> Fst:
    """Intention, harm and its target, each at most `skip` words after the one before; the target becomes Z."""
    symbols = BASE + "xy" + MARKED
    rules: list[tuple] = [(0, symbols, None, 0.0, 0), (0, "w", None, 0.0, 1)]
    free = _without(symbols, "n")  # what is denied is no threat
    first, second = 1, 2 + skip
    for k in range(skip + 1):
        rules += [(first + k, "h", None, 0.5, second), (second + k, "t", "Z", 2.5, 0)]
        if k < skip:
            rules += [(first + k, free, None, -0.1, first + k + 1), (second + k, free, None, -0.1, second + k + 1)]
    return Fst.of((0,), *rules)


def insult(aimed: float = 1.25, denied: float = -0.5, quoted: float = 0.1) -> Fst:
    """What each symbol weighs."""
    rules: list[tuple] = [(0, _without(BASE, STRENGTHS) + "Z", None, 0.0, 0), (0, "x", None, denied, 0), (0, "y", None, quoted, 0)]
    for s, w in WEIGHTS.items():
        rules += [(0, s, None, w, 0), (0, s.upper(), None, aimed * w + 0.5, 0)]
    return Fst.of((0,), *rules)


@lru_cache(maxsize=1)
def grammar() -> Fst:
    return negation().compose(reported()).compose(target()).compose(threat()).compose(insult())


#: Other words in a row beyond which nothing is remembered but quotation.
FAR = 6
_RUN = regex.compile("o{%d,}" % (FAR + 1))


@lru_cache(maxsize=50_000)
def _short_clause(symbols: str) -> tuple[float, int, int, int, int, int]:
    weight, out = grammar().best(symbols)
    n = Counter(out)
    return weight, sum(n[s] for s in STRENGTHS), sum(n[s] for s in MARKED), n["Z"], n["x"], n["y"]


def clause(symbols: str) -> tuple[float, int, int, int, int, int]:
    """Of a clause its score, and how many insults alone, aimed insults, threats, denied and reported insults it has."""
    symbols = _RUN.sub("o" * FAR, symbols)
    return _short_clause(symbols) if len(symbols) <= 80 else _short_clause.__wrapped__(symbols)


# --- lexicon ---


@dataclass(frozen=True)
class Lexicon:
    """Classes of words and of word beginnings."""

    words: dict[str, str]
    stems: dict[str, str]

    def symbol(self, word: str) -> str:
        found = self.words.get(word)
        if found:
            return found
        for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return "o"


def _g2(a: float, n1: float, b: float, n0: float) -> float:
    """Likelihood ratio statistic that a of n1 texts and b of n0 have the same share."""
    total, out = (a + b) / (n1 + n0), 0.0
    for k, n in ((a, n1), (b, n0)):
        for x, p in ((k, total), (n - k, 1 - total)):
            if x > 0:
                out += 2 * x * math.log(x / (n * p))
    return out


def _texts_with(where: dict[str, tuple[list[int], list[int]]], known: dict[str, str], size: Counter) -> dict[str, tuple[int, int]]:
    """Word beginnings in far more toxic texts than others: how many other and how many toxic texts have them."""
    ids: dict[str, int] = {}
    words = [w for w in where if w not in known and len(w) >= SHORTEST]
    starts = np.array([[ids.setdefault(w[:n], len(ids)) if n <= len(w) else -1 for n in range(SHORTEST, LONGEST + 1)] for w in words], np.int64).reshape(-1, LONGEST - SHORTEST + 1)
    counts = []
    for y in (0, 1):
        text = np.array([i for w in words for i in where[w][y]], np.int64)
        of = np.repeat(starts, [len(where[w][y]) for w in words], axis=0)
        n = np.zeros(len(ids), np.int64)
        for k in range(of.shape[1]):
            has = of[:, k] >= 0
            pairs = np.unique(of[has, k] << 32 | text[has])
            n += np.bincount(pairs >> 32, minlength=len(ids))
        counts.append(n)
    far = (counts[1] >= LEAST_TEXTS) & (counts[1] * size[0] > LEAST_RATIO * counts[0] * size[1])
    names = list(ids)
    return {names[i]: (int(counts[0][i]), int(counts[1][i])) for i in np.flatnonzero(far)}


def learn(texts: list[tuple[list[str], int]]) -> Lexicon:
    """The lexicon of labelled texts (words, label)."""
    words = {w: s for s, ws in CLASSES.items() for w in ws.split()}
    seeds = {w: SEED for w in INSULTS.split()}
    size = Counter(y for _, y in texts)
    total = Counter()
    where: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    times: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for i, (ws, y) in enumerate(texts):
        total[y] += len(ws)
        for w, n in Counter(ws).items():
            where[w][y].append(i)
            times[w][y] += n
    if not size[1] or not size[0]:
        return Lexicon(seeds | words, {})
    seen = _texts_with(where, words, size)
    order = sorted(where)
    strong = [(-_g2(a, size[1], b, size[0]), -len(u), u) for u, (b, a) in seen.items()]
    stems: dict[str, str] = {}
    lexicon = Lexicon(words, stems)
    for g, _, unit in sorted(strong):
        if -g < LEAST_G2:
            break
        lo = bisect.bisect_left(order, unit)
        new = []  # words that no unit holds so far
        while lo < len(order) and order[lo].startswith(unit):
            if lexicon.symbol(order[lo]) == "o":
                new.append(order[lo])
            lo += 1
        a, b = (len({i for w in new for i in where[w][y]}) for y in (1, 0))
        if a < LEAST_TEXTS or a * size[0] <= LEAST_RATIO * b * size[1] or _g2(a, size[1], b, size[0]) < LEAST_G2:
            continue
        rate = [(sum(times[w][y] for w in new) + 0.5) / (total[y] + 1) for y in (0, 1)]
        stems[unit] = STRENGTHS[bisect.bisect(BOUNDS, math.log(rate[1] / rate[0]))]
    known = {}
    for w, s in seeds.items():
        n1, n0 = (len(where[w][y]) if w in where else 0 for y in (1, 0))
        if n1 + n0 >= 2 * LEAST_TEXTS and n1 * size[0] < 2 * n0 * size[1]:
            continue  # the labels know it as harmless
        if lexicon.symbol(w) == "o":
            known[w] = s
    return Lexicon(known | words, stems)


# --- texts ---


class Reader:
    """Features of texts, with the classes of words kept between calls."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, {}

    def symbols(self, words: Iterable[str]) -> dict[str, str]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.lexicon.symbol(w)
        return known

    def clauses(self, text: str) -> Iterator[str]:
        """Strings of classes of the clauses with an insult or harm; clauses end at punctuation and line ends."""
        known, held, core = self.known, [], False
        for m in PIECES.finditer(text):
            if m.lastgroup == "word":
                s = known[m.group()]
                core = core or s in "habcd"
                held.append(s)
            elif m.lastgroup == "quote":
                held.append("q")
            else:
                if core:
                    yield "".join(held)
                held, core = [], False
        if core:
            yield "".join(held)

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = LETTERS.findall(low)
        distinct = set(words)
        known = self.symbols(distinct)
        found = [0.0] * 6
        most = 0.0
        if any(known[w] in "habcd" for w in distinct):
            for c in self.clauses(low):
                got = clause(c)
                most = max(most, got[0])
                found[0] += max(0.0, got[0])
                for k in range(1, 6):
                    found[k] += got[k]
        total, n = found[0], len(words)
        return [float(total > 0), math.log1p(total), math.log1p(100 * total / max(n, 1)), most / 4, math.log1p(found[1]), math.log1p(found[2]), math.log1p(found[3]), math.log1p(found[4]), math.log1p(found[5]), float(total > 0) * math.log1p(n) / 4]


#: Weights set by hand: the intercept, then one for each feature.
PRIOR = np.array([-4.0, 1.0, 1.0, 0.5, 0.5, 0.2, 0.5, 1.5, -0.5, -0.5, -0.2])
#: How strongly weights are pulled towards those.
PULL = 0.5


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a normal prior around those set by hand."""
    design = np.column_stack([np.ones(len(x)), x])
    b = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - PULL * (b - PRIOR)
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + PULL * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, reader: Reader, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([reader.features(t) for t in texts], float).reshape(-1, len(PRIOR) - 1)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, train_chars: int = TRAIN_CHARS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels of a bounded sample of the training side, and how many labels of either kind there are in all."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training_side())
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    h = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30))
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("toxic") == label, F.lit(int(min(1.0, 1.2 * (per_label + 20) / n) * (1 << 30)))).otherwise(limit)
    picked = rows.where(h < limit).dropDuplicates()  # about 1.2 per_label rows of either label
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, train_chars).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("h", h).collect()
    out, taken, met = [], Counter(), set()
    for r in sorted(found, key=lambda r: (r["h"], r["doc_id"], r["toxic"])):
        if taken[r["toxic"]] < per_label and (r["text"], r["toxic"]) not in met:
            met.add((r["text"], r["toxic"]))
            taken[r["toxic"]] += 1
            out.append((r["text"], r["toxic"]))
    return out, counts


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    return trained(*sample(docs, labels, **how))


def trained(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """The model of texts and labels, weighed so that either label counts as in `counts`."""
    parted = [(LETTERS.findall(text.lower()), y) for text, y in rows]
    x, y = [], []
    for k in (0, 1):
        reader = Reader(learn(parted[1 - k :: 2]))
        x += [reader.features(text) for text, _ in rows[k::2]]
        y += [label for _, label in rows[k::2]]
    if not rows:
        return Model(learn([]), PRIOR)
    got = Counter(y)
    share = {label: counts[label] / n for label, n in got.items()}
    scale = len(y) / sum(share[label] * n for label, n in got.items())
    return Model(learn(parted), fit(np.array(x), np.array(y, float), np.array([share[label] * scale for label in y])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.lexicon)
        for batch in in_parts(tidy(batches), 2000, "text", 8_000_000):
            found = shared.value.scores(reader, (t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(~training_side(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Train on labels of the training side, score every row of docs."""
    return score(docs, train(docs, labels, **how))
