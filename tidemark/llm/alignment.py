"""Operator 12: alignment of two tokenizers by byte offsets, with corpus-wide counts of linked id pairs.

Every text is encoded by both tokenizers; where tokens of both end at the same byte, a group ends, and all tokens of one
group are linked with each other.  A pair of ids is one packed 64-bit key (`a << 32 | b`).  Tasks reduce keys to partial
counts with np.unique, so a pair is shuffled once a task at most however frequent it is; a range partitioning sorts them
globally, and runs of equal keys are summed as they stream by.  Each range is written as a shard of sorted keys and counts,
which lookups map into memory (or read, where the shared folder is no file system) and search with np.searchsorted.

Neither tokenizer has a token across a single space and what precedes it, so the words between single spaces are
aligned one by one, each distinct word once (`by_spaces` reads this from the tokenizers; other texts, and all texts of other
tokenizers, are aligned whole). Texts are encoded once: what a text links is written to the shared folder, a distinct pair and its number of occurrences
in the text each, and read for the counts and for the lookups.  A batch of texts is one run of bytes for NumPy.

The counts grow with the pairs of the two vocabularies, not with the corpus.  What the driver sees are one row a shard (its
address, first key and length); the highest count of an id of A is a table of its vocabulary's size.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros,
and '' as digest; repeated rows are documents of their own, and each counts; rows with a null id get their row and count
too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import in_parts, materialize, open_input, open_output, tidy
from .tokens import gathered, uncollected

#: Bytes of text and rows encoded at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 1_500_000
#: Occurrence pairs of groups that are made at once, and keys that a task holds before they are reduced.
PAIRS, HELD_KEYS = 4_000_000, 4_000_000
SHIFT = 32


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- the two tokenizers ---


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bytes:
    """The bytes of a vocabulary's entries by id, in one flat array."""

    def __init__(self, entries: list[bytes]) -> None:
        self.length = np.array([*map(len, entries)], np.int64)
        self.start = self.length.cumsum() - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.start[ids], self.length[ids])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.array([*map(len, lists)], np.int64)


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab()
        with open(path, encoding="utf-8") as f:
            special = {t["content"] for t in json.load(f).get("added_tokens", [])}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            entries[i] = piece.encode() if piece in special else bytes(alphabet[c] for c in piece)
        self.bytes = Bytes(entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        return _flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


class Pieces:
    """A sentencepiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = Bytes(entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        return _flat(self.model.encode(texts, num_threads=1))


# --- a batch of texts ---


def _whole(words: list[str], a: ByteLevel, b: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which texts (none is empty) both tokenizers give back, these texts' ids of A and of B in a row, and how many each has."""
    given = [b" " + w.encode() for w in words]
    length = np.array([*map(len, given)], np.int64)
    flat = np.frombuffer(b"".join(given), np.uint8)
    found = []
    ok = np.ones(len(words), bool)
    for t, texts in ((a, [" " + w for w in words]), (b, words)):
        ids, size = t.encode(texts)
        of = np.repeat(np.arange(len(words)), size)
        ok &= np.bincount(of, t.bytes.length[ids], len(words)) == length
        found.append((t, ids, size, of))
    owner = np.repeat(np.arange(len(words)), length)
    out = []
    for t, ids, _, of in found:
        same = t.bytes.of(ids[ok[of]]) == flat[ok[owner]]
        ok[owner[ok[owner]][~same]] = False
    for _, ids, size, of in found:
        out += [ids[ok[of]], size[ok]]
    return np.flatnonzero(ok), out[0], out[2], out[1], out[3]


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to size - 1, left-aligned with one free place, and how many they are."""
    width = len(str(size)) + 1
    text = np.array([str(i) for i in range(size)], f"S{width}")
    return text.view(np.uint8).reshape(size, width).copy(), np.char.str_len(text).astype(np.int64)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, ends: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document; `ends`: how many groups end up to the end of each document."""
    n_a, n_b = (np.bincount(g, minlength=groups) for g in (group_a, group_b))
    at_a = np.arange(len(ids_a)) + (n_b.cumsum() - n_b)[group_a]
    at_b = np.arange(len(ids_b)) + n_a.cumsum()[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    after = np.full(len(ids), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    last_b = (n_a + n_b).cumsum() - 1
    after[last_b - n_b], after[last_b] = ord("|"), ord(";")
    digits, length = _decimals(1 << int(max(ids.max(initial=1), 1 << 15)).bit_length())
    rows, size = digits[ids], length[ids]
    rows[np.arange(len(ids)), size] = after
    flat = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
    chars = np.r_[0, (size + 1).cumsum()][np.r_[0, last_b[ends - 1] + 1]]
    return [flat[x : y - 1] for x, y in zip(chars[:-1].tolist(), chars[1:].tolist(), strict=True)]


def _runs(owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, id) in order, and how often each occurs; owner ascends."""
    packed, n = np.unique(owner << SHIFT | ids, return_counts=True)
    return packed >> SHIFT, packed & ((1 << SHIFT) - 1), n


def links_of(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key and occurrences of the linked pairs of every group, each document's distinct pairs once, in order.

    Groups are taken a few at a time, and a large group in parts of its A tokens: memory does not grow with a group's square.
    """
    groups = len(doc_of_group)
    ga, a, ca = _runs(group_a, ids_a)
    gb, b, cb = _runs(group_b, ids_b)
    n_b = np.bincount(gb, minlength=groups)
    first_b = n_b.cumsum() - n_b
    made = n_b[ga].cumsum()  # pairs up to each distinct A id of a group
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(made, (made[lo - 1] if lo else 0) + PAIRS, "right")))
        n = n_b[ga[lo:hi]]
        left = np.repeat(np.arange(lo, hi), n)
        right = np.repeat(first_b[ga[lo:hi]] - (n.cumsum() - n), n) + np.arange(len(left))
        parts.append(_summed(doc_of_group[ga[left]], a[left] << SHIFT | b[right], ca[left] * cb[right]))
        if len(parts) > 1:  # few pairs are distinct, so what is held stays small
            parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        lo = hi
    return parts[0] if parts else (np.zeros(0, np.int64),) * 3


def _summed(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) in order, with sums of n."""
    order = np.lexsort((key, doc))
    doc, key, n = doc[order], key[order], n[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(doc)])
    return doc[new], key[new], np.add.reduceat(n, new) if len(new) else n[:0]


# --- units ---

#: The white space of Unicode, with the separators that some libraries count as such.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts in which a space is not a single one between other characters.
ODD_SPACES = rf"{WHITE}\x20|\x20{WHITE}|^{WHITE}|\x20$"
#: Units that a process keeps, and the characters of one.
KEPT_UNITS, UNIT_CHARACTERS = 400_000, 24


def by_spaces(path_a: str, b: Pieces) -> bool:
    """Whether neither tokenizer has a token across a single space and what precedes it.

    Then both have a token end before each such space, so the words between single spaces, the space before each
    included, are aligned one by one and each distinct one once.
    """
    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    inner = any("▁" in b.model.id_to_piece(i).lstrip("▁") for i in range(b.model.get_piece_size()) if not b.model.is_control(i))
    return plain and not inner and not any(" " in t["content"] for t in spec.get("added_tokens", []))


class Units:
    """Alignments of words between single spaces, or of whole texts; those of short words are kept between calls."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.split = by_spaces(path_a, self.b)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.ok = np.zeros(0, bool)
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.start = self.length = self.key = self.times = np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        """Align these strings; their places follow those known so far."""
        n = len(words)
        kept, ids_a, ids_b, size_a, size_b = _whole(words, self.a, self.b)
        ok, numbers, length = np.zeros(n, bool), np.zeros((n, 4), np.int64), np.zeros(n, np.int64)
        texts = [b""] * n
        key = times = np.zeros(0, np.int64)
        if len(kept):
            end_a, end_b = self.a.bytes.length[ids_a].cumsum(), self.b.bytes.length[ids_b].cumsum()
            shared = np.intersect1d(end_a, end_b, assume_unique=True)
            group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
            last = np.searchsorted(shared, end_a[size_a.cumsum() - 1]) + 1  # groups up to the end of each text
            each = np.diff(last, prepend=0)
            doc, key, times = links_of(ids_a, ids_b, group_a, group_b, np.repeat(np.arange(len(kept)), each))
            per_group = np.bincount(group_a, minlength=len(shared)) * np.bincount(group_b, minlength=len(shared))
            ok[kept] = True
            numbers[kept] = np.stack([size_a, size_b, each, np.add.reduceat(per_group, np.r_[0, last[:-1]])], 1)
            length[kept] = np.bincount(doc, minlength=len(kept))
            for i, text in zip(kept.tolist(), group_texts(ids_a, ids_b, group_a, group_b, len(shared), last), strict=True):
                texts[i] = text
        self.texts += texts
        self.ok, self.numbers = np.r_[self.ok, ok], np.concatenate([self.numbers, numbers])
        self.start, self.length = np.r_[self.start, len(self.key) + length.cumsum() - length], np.r_[self.length, length]
        self.key, self.times = np.r_[self.key, key], np.r_[self.times, times]

    def _cut(self, kept: int) -> None:
        """Forget what is beyond the units that are kept."""
        del self.texts[kept:]
        links = int(self.start[kept]) if kept < len(self.start) else len(self.key)
        self.ok, self.numbers, self.start, self.length = self.ok[:kept], self.numbers[:kept], self.start[:kept], self.length[:kept]
        self.key, self.times = self.key[:links], self.times[:links]

    def places(self, words: list[str]) -> np.ndarray:
        """Places of distinct strings; those of long ones hold until the next call only."""
        known = self.known
        self._cut(len(known))
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEPT_UNITS:
            self.clear()
            known, new = self.known, words
        short, long = [w for w in new if len(w) <= UNIT_CHARACTERS], [w for w in new if len(w) > UNIT_CHARACTERS]
        at = len(known)
        known.update(zip(short, range(at, at + len(short)), strict=True))
        passing = dict(zip(long, range(at + len(short), at + len(new)), strict=True))
        self._add(short + long)
        return np.array([known[w] if w in known else passing[w] for w in words], np.int64)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]


def aligned(ids: pa.Array, texts: pa.Array, units: Units) -> pa.RecordBatch:
    """What each text of a batch links: its counts, the digest of its groups, its distinct pairs and how often it has each."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy()
    plain = (size > 0) & ~pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False) if units.split else np.zeros(n, bool)
    while True:
        rows = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        words = rows.flatten().dictionary_encode()
        whole = texts.filter(pa.array((size > 0) & ~plain)).dictionary_encode()
        distinct = words.dictionary.to_pylist() + whole.dictionary.to_pylist()
        count = np.where(size > 0, 1, 0)
        count[plain] = np.diff(rows.offsets.to_numpy())
        owner = np.repeat(np.arange(n), count)
        code = np.empty(len(owner), np.int64)
        code[plain[owner]] = words.indices.to_numpy()
        code[~plain[owner]] = whole.indices.to_numpy() + len(words.dictionary)
        once = list(dict.fromkeys(distinct))
        at = dict(zip(once, units.places(once).tolist(), strict=True))  # a word may be a whole text, too
        place = np.array([at[w] for w in distinct], np.int64)
        unit = place[code] if len(code) else code
        bad = np.bincount(owner[~units.ok[unit]], minlength=n) > 0
        if not (bad & plain).any():
            break
        plain = plain & ~bad  # once more, as whole texts
    unit, owner = unit[~bad[owner]], owner[~bad[owner]]
    numbers = np.stack([np.bincount(owner, units.numbers[unit, k], n) for k in range(4)]).astype(np.int64)
    digest = [""] * n
    edge = np.searchsorted(owner, np.arange(n + 1)).tolist()
    at = unit.tolist()
    for i in np.flatnonzero(np.diff(edge)).tolist():
        digest[i] = hashlib.sha256(b";".join([units.texts[u] for u in at[edge[i] : edge[i + 1]]])).hexdigest()
    packed = np.sort(owner << SHIFT | unit)
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]][: len(packed)])
    repeats = np.diff(np.r_[first, len(packed)])
    of, unit = packed[first] >> SHIFT, packed[first] & ((1 << SHIFT) - 1)
    length = units.length[unit]
    key = gathered(units.key, units.start[unit], length)
    doc, key, times = _summed(np.repeat(of, length), key, gathered(units.times, units.start[unit], length) * np.repeat(repeats, length))
    bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (key, times)]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in numbers], pa.array(digest, pa.string()), *lists], names=COLUMNS)


@lru_cache(maxsize=1)
def units_of(path_a: str, path_b: str) -> Units:
    """This process's units, kept between tasks."""
    return Units(path_a, path_b)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(path_a, path_b)
        for batch in in_parts(tidy(batches), BATCH_ROWS, "text", BATCH_BYTES):
            with uncollected():
                out = aligned(batch.column(0), batch.column(1), units)
            yield out

    longs = " long, ".join(COLUMNS[:5]) + " long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{longs}, groups_sha256 string, keys array<long>, times array<long>")


# --- counts ---


def _merged(key: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(key), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(n), len(keys)).astype(np.int64)


def partial_counts(links: DataFrame) -> DataFrame:
    """(key, n): in how many documents of a part of the rows each pair is linked; a pair comes once a task, or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        waiting = 0
        for batch in tidy(batches):
            new, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            keys.append(new)
            counts.append(n)
            waiting += len(new)
            if waiting > HELD_KEYS:
                k, n = _merged(keys, counts)
                if len(k) > HELD_KEYS // 2:  # even reduced they are many
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
                    k, n = k[:0], n[:0]
                keys, counts, waiting = [k], [n], len(k)
        if waiting:
            k, n = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

    return links.select("keys").mapInArrow(run, "key long, n long")


def write_shards(partial: DataFrame) -> DataFrame:
    """Sum partial counts into shards of sorted keys and counts: a row (path, first, length) for each shard.

    A shard is `length` keys, then as many counts, little-endian 64-bit. An attempt that is repeated writes a file of its own,
    and only what the successful one returns is read.
    """
    spark = partial.sparkSession
    base = shared_dir(spark, "pair-counts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            key, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, value = key[first], np.add.reduceat(value, first)
            if keys and keys[-1][-1] == key[0]:  # a run that goes on
                sums[-1][-1] += value[0]
                key, value = key[1:], value[1:]
            if len(key):
                keys.append(key)
                sums.append(value)
        if keys:
            key, value = np.concatenate(keys).astype("<i8"), np.concatenate(sums).astype("<i8")
            path = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.counts"
            with open_output(path) as out:
                out.write(key.tobytes())
                out.write(value.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(key[0])]), pa.array([len(key)])], names=["path", "first", "length"])

    dealt = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(run, "path string, first long, length long"), "count-shards", one_file=True)


class Shards:
    """Sorted count shards, mapped into memory one by one."""

    def __init__(self, shards: list[tuple[str, int, int]]) -> None:
        self.shards = sorted(shards, key=lambda s: s[1])
        self.first = np.array([s[1] for s in self.shards], np.int64)

    @staticmethod
    @lru_cache(maxsize=4)
    def _open(path: str, length: int) -> tuple[np.ndarray, np.ndarray]:
        if path.startswith("file:"):
            mapped = np.memmap("/" + path.removeprefix("file:").lstrip("/"), "<i8", "r", shape=(2 * length,))
        else:
            with open_input(path) as f:
                mapped = np.frombuffer(f.read(), "<i8")
        return mapped[:length], mapped[length:]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; keys ascend, and all are known."""
        out = np.zeros(len(keys), np.int64)
        edge = np.r_[np.searchsorted(keys, self.first), len(keys)] if len(self.first) else np.zeros(1, np.int64)
        for (path, _, length), lo, hi in zip(self.shards, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi > lo:
                key, n = self._open(path, length)
                out[lo:hi] = n[np.searchsorted(key, keys[lo:hi])]
        return out


def highest(spark, shards: list[tuple[str, int, int]], vocabulary: int) -> np.ndarray:
    """The highest count of each id of A: each shard is reduced in a task of its own, and the results have an id twice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = Shards._open(path, length)
                a = key >> SHIFT
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(np.maximum.reduceat(n, first))], names=["a", "n"])

    best = np.zeros(vocabulary, np.int64)
    if shards:
        listed = spark.createDataFrame([(p, n) for p, _, n in shards], "path string, length long").repartition(len(shards))
        found = listed.mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()  # bounded by the vocabulary
        best[found.column("a").to_numpy()] = found.column("n").to_numpy()
    return best


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    paths = default_paths()
    path_a, path_b = path_a or paths[0], path_b or paths[1]
    links = materialize(alignments(docs, path_a, path_b), "links")
    shards = [(r["path"], r["first"], r["length"]) for r in write_shards(partial_counts(links)).collect()]  # one row a shard
    best = highest(spark, shards, len(ByteLevel(path_a).bytes.length))
    known = spark.sparkContext.broadcast((shards, best))  # a row a shard, a number for each id of A

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, most = Shards(known.value[0]), known.value[1]
        for whole in tidy(batches):
            for batch in in_parts(iter([whole]), 500, "keys", 8_000_000):
                keys, times = (batch.column(i) for i in (6, 7))
                flat, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (keys, times))
                distinct, place = np.unique(flat, return_inverse=True)
                count = table.counts(distinct)[place]
                edge = keys.offsets.to_numpy().astype(np.int64)
                total = lambda v: np.diff(np.r_[0, v.cumsum()][edge - edge[0]])  # noqa: B023, E731
                n_best = total(n * (count == most[flat >> SHIFT]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n_best), pa.array(total(n * count)), batch.column(5)], names=[*COLUMNS[:5], "n_best", "count_sum", COLUMNS[5]])

    longs = " long, ".join([*COLUMNS[:5], "n_best", "count_sum"]) + " long"
    return links.mapInArrow(run, f"{longs}, groups_sha256 string")
