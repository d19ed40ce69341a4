"""Encoding with a tokenizer, word by word where its pre-tokens never cross white space.

The ids of a text are then the ids of its white-space delimited words in a row, so each distinct word is given to the
library once and kept.  Texts are parted, words are told apart and ids are put together on Arrow and NumPy arrays; only
words met for the first time become Python objects.  ASCII white space alone delimits: whatever else the tokenizer takes
for a space stays inside a word and is left to the library.  A tokenizer of any other make encodes whole texts.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CACHE_WORDS = 500_000
#: Rows and bytes of text encoded at once.
ROWS, BYTES = 4_000, 8_000_000
#: Letter words given to the library as one text, and such texts given at once.
JOINED, TEXTS = 512, 32
#: ASCII punctuation that the tokenizer always parts from the letters before it: all but the apostrophe.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Fixed value: the pre-token pattern of which words in a row are the pre-tokens of a text.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Normalizers that change no white space into anything else, and nothing across it.
PLAIN_NORMALIZERS = {"NFC", "Lowercase"}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(section: dict | None, name: str) -> list[dict]:
    """A normalizer or pre-tokenizer as a list of its steps."""
    return [] if section is None else section[name] if section["type"] == "Sequence" else [section]


def by_words(spec: dict) -> tuple[bool, bool]:
    """Of a tokenizer's description: whether a text's ids are its words' ids in a row, and whether it makes letters lower-case."""
    steps = _parts(spec.get("normalizer"), "normalizers")
    plain = all(s["type"] in PLAIN_NORMALIZERS or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
    cuts = _parts(spec.get("pre_tokenizer"), "pretokenizers")
    split = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["pattern"] == {"Regex": WORD_PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    bare = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in cuts[1:])
    special = all(t["special"] and not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    suffix = bool(spec["model"].get("end_of_word_suffix"))
    return plain and split and bare and special and suffix, any(s["type"] == "Lowercase" for s in steps)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length] one after the other."""
    end = length.cumsum()
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start - (end - length), length) + np.arange(total)]


class _Table:
    """Strings (Arrow) and the ids of each in one flat array."""

    def __init__(self) -> None:
        self.keys: pa.Array = pa.array([], pa.string())
        self.start = self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def add(self, keys: list[pa.Array], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        """More strings, the ids of all of them and how many each has."""
        length = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.start = np.concatenate([self.start, len(self.flat) + length.cumsum() - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, *ids])
        self.keys = pa.concat_arrays([self.keys, *keys])

    def keep(self, rows: np.ndarray) -> None:
        """These rows only."""
        length = self.length[rows]
        self.flat = gathered(self.flat, self.start[rows], length)
        self.keys, self.length, self.start = self.keys.take(pa.array(rows)), length, length.cumsum() - length


class WordEncoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    Words of letters alone, and what precedes trailing marks, are single pre-tokens, so many of them go to the library
    as one text and are told apart by the end-of-word ids; all other words are encoded one by one.  Beyond `cache_words`
    distinct letter words only those of the last texts are kept.
    """

    def __init__(self, path: str, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words, self.lowers = by_words(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.by_words:
            suffix = spec["model"]["end_of_word_suffix"]
            self.closes[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.end = np.array([end_id], "<u4")
        self.most = cache_words
        self.letters = _Table()

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that are encoded one by one, and how many each has."""
        ids, length = [np.zeros(0, "<u4")], []
        for at in range(0, len(words), 5_000):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 5_000], add_special_tokens=False):
                ids.append(np.array(e.ids, "<u4"))
                length.append(len(ids[-1]))
        return np.concatenate(ids), np.array(length, np.int64)

    def _table(self, words: pa.Array) -> _Table:
        out = _Table()
        ids, length = self._alone(words.to_pylist())
        out.add([words], [ids], [length])
        return out

    def _learn(self, words: pa.Array) -> None:
        """Learn words of letters."""
        keys, flat, lengths = [], [], []
        for at in range(0, len(words), JOINED * TEXTS):
            some = words.slice(at, JOINED * TEXTS)
            edges = np.r_[np.arange(0, len(some), JOINED), len(some)].astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), some), " ").to_pylist()
            for lo, hi, e in zip(edges[:-1].tolist(), edges[1:].tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                length = np.diff(ends, prepend=0)
                if len(ends) != hi - lo:  # what is no letter to the tokenizer, or turns into something else
                    ids, length = self._alone(some.slice(lo, hi - lo).to_pylist())
                flat.append(ids)
                lengths.append(length)
            keys.append(some)
        self.letters.add(keys, flat, lengths)

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a flat array, and where each word's start and how many they are."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        marked = plain & (pc.binary_length(stems).to_numpy() < pc.binary_length(words).to_numpy())
        letters = self.letters
        need = pc.unique(stems.filter(pa.array(plain)))
        new = need.filter(pc.is_null(pc.index_in(need, value_set=letters.keys)))
        if len(letters.keys) + len(new) > self.most and len(letters.keys):
            used = pc.index_in(need, value_set=letters.keys).drop_null().to_numpy().astype(np.int64)
            letters.keep(used)
        self._learn(new)
        stem = pc.index_in(stems, value_set=letters.keys).fill_null(0).to_numpy()
        tails = pc.replace_substring_regex(words.filter(pa.array(marked)), pattern=r"^\pL+", replacement="").dictionary_encode()
        after, rest = self._table(tails.dictionary), self._table(words.filter(pa.array(~plain)))
        # two pieces a word: its letters or the whole of it, and its marks
        n = len(words)
        start, length = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        if plain.any():
            start[plain, 0], length[plain, 0] = letters.start[stem[plain]], letters.length[stem[plain]]
        tail = tails.indices.to_numpy()
        start[marked, 1], length[marked, 1] = len(letters.flat) + after.start[tail], after.length[tail]
        start[~plain, 0], length[~plain, 0] = len(letters.flat) + len(after.flat) + rest.start, rest.length
        flat = gathered(np.concatenate([letters.flat, after.flat, rest.flat]), start.ravel(), length.ravel())
        size = length.sum(1)
        return flat, size.cumsum() - size, size

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by the end id, and where each text's ids start and end."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            flat, size = self._alone(texts.to_pylist())
            return np.insert(flat, size.cumsum(), self.end[0]), np.r_[0, (size + 1).cumsum()]
        if self.lowers:  # ASCII letters alone: special tokens are told by case, and others fold by rules of their own
            same = pc.or_(pc.match_substring(texts, "<|"), pc.invert(pc.string_is_ascii(texts)))
            texts = pc.if_else(same, texts, pc.ascii_lower(texts))
        rows = pc.ascii_split_whitespace(texts)
        words = rows.flatten().dictionary_encode()
        edge = rows.offsets.to_numpy().astype(np.int64)
        flat, start, size = self._vocabulary(words.dictionary)
        # the end id is one more word, after the words of each text
        codes = np.insert(words.indices.to_numpy().astype(np.int64), edge[1:] - edge[0], len(start))
        start, size = np.r_[start, len(flat)], np.r_[size, 1]
        length = size[codes]
        out = gathered(np.concatenate([flat, self.end]), start[codes], length)
        return out, np.r_[0, length.cumsum()][edge - edge[0] + np.arange(len(edge))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        flat, edge = self.encode_column(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: many small objects are made, none in a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=1)
def word_encoder(path: str, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """This process's encoder, which keeps what it has learned between tasks."""
    return WordEncoder(path, end_id, cache_words)
