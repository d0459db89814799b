"""Byte-pair encoding by forced-boundary splitting, and the matching decoder.

A byte pair that occurs inside no vocabulary token can never be joined by a merge. The table of such
pairs is derived from the vocabulary. A text is cut where a forced pair meets a place at which cutting
also leaves the library's pre-tokenisation as it is: before ASCII white space, or between two ASCII
letters. (Before white space, the left part ends as at the end of a text and the right part starts a
new match; between letters, both parts lie in one run of letters.) The fragments are encoded
independently, each distinct one once, and their ids are joined.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cached_property

import numpy as np

from . import worker

WHITE = b"\t\n\r "
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))

# The pre-tokenisation patterns of byte-level and word-end vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Library:
    """The library's tokenizer for ``self.path``, loaded when first asked for."""

    path: str

    @cached_property
    def tokenizer(self):
        return load_tokenizer(self.path)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _dtype(vocab: dict[str, int]) -> np.dtype:
    """The narrower of two types that holds all ids."""
    return np.dtype("<u2") if max(vocab.values(), default=0) < 65536 else np.dtype("<u4")


def vocabulary_dtype(path: str) -> np.dtype:
    with open(path, encoding="utf-8") as f:
        return _dtype(json.load(f)["model"]["vocab"])


class _Fragments:
    """Distinct fragments and their ids, within a byte budget; ``encode`` turns one fragment into its ids."""

    def __init__(self, encode, dtype, budget: int):
        self.encode, self.dtype, self.budget, self.held = encode, dtype, budget, 0
        self.ids: dict = {}

    def learn(self, fragments: set) -> None:
        new = fragments.difference(self.ids)
        if new and self.held > self.budget:
            self.ids.clear()
            self.held, new = 0, fragments
        for fragment in new:
            self.ids[fragment] = got = array(self.dtype.char, self.encode(fragment)).tobytes()
            self.held += len(fragment) + len(got) + 160

    def encode_batch(self, texts: list[str], special, split, whole) -> list[np.ndarray]:
        """Ids of each text, in groups of bounded size; texts with special tokens go to ``whole``."""
        out: list = [None] * len(texts)
        lo = 0
        while lo < len(texts):
            hi, n, parts = lo, 0, []
            while hi < len(texts) and (hi == lo or n < 1_000_000):
                parts.append(None if any(s in texts[hi] for s in special) else split(texts[hi]))
                n += len(texts[hi])
                hi += 1
            self.learn({x for part in parts for x in part or ()})
            get = self.ids.__getitem__
            for i, part in zip(range(lo, hi), parts, strict=True):
                out[i] = np.array(whole(texts[i]), self.dtype) if part is None else np.frombuffer(b"".join(map(get, part)), self.dtype)
            lo = hi
        return out


def _ranked(token_bytes: dict[bytes, int], pattern: str):
    """The same merges as ranks, for the library that encodes single pieces fastest."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_bytes, special_tokens={})


def _ordered(merges: list, vocab: dict, base: int) -> bool:
    """Are ids given in the order of the merges, so that ids can serve as ranks?"""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    return all(vocab.get(a + b) == base + i for i, (a, b) in enumerate(pairs))


class ForcedBoundaryBPE(_Library):
    """Encoder and decoder for a byte-level vocabulary file; ids equal the library's."""

    def __init__(self, path: str, cache_bytes: int = 48_000_000):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_of_char()
        self.dtype = _dtype(spec["model"]["vocab"])
        self.token_bytes: list[bytes] = [b""] * (max(spec["model"]["vocab"].values(), default=0) + 1)
        inside = np.zeros(65536, bool)
        for token, i in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            raw = bytes(chars[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a << 8 | b] = True
        for token, i in self.special.items():
            self.token_bytes.extend([b""] * (i + 1 - len(self.token_bytes)))
            self.token_bytes[i] = token.encode()
        self.forced = ~inside
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        letters = np.isin(first, list(LETTERS)) & np.isin(second, list(LETTERS))
        self.cut = self.forced & (np.isin(second, list(WHITE)) | letters)
        # Special tokens part a text as the library parts it, unless they take in white space or stand apart as words.
        plain = not any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word", "normalized"))
        self._special_bytes = {k.encode(): i for k, i in self.special.items()} if plain else {}
        self._parts = re.compile("|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._ranks = None
        if _ordered(spec["model"]["merges"], spec["model"]["vocab"], 256):
            ranks = {b: i for i, b in enumerate(self.token_bytes) if b and i not in self.special.values()}
            self._ranks = _ranked(ranks, BYTE_PATTERN)
            encode = self._fragment
        else:
            encode = lambda x: self._whole(x.decode())
        self._fragments = _Fragments(encode, self.dtype, cache_bytes)

    def _fragment(self, x: bytes) -> list[int]:
        """Ids of one fragment; a word with or without a leading space, or a last mark, needs no pattern."""
        if x in self._special_bytes:
            return [self._special_bytes[x]]
        core = x[1:] if x[:1] == b" " else x
        if core.isalpha():
            return self._ranks._core_bpe.encode_single_piece(x)
        if core[:-1].isalpha() and core[-1] in b".,":
            return [*self._ranks._core_bpe.encode_single_piece(x[:-1]), *self._ranks._core_bpe.encode_single_piece(x[-1:])]
        return self._ranks.encode_ordinary(x.decode())

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        """The same ids without cutting: fastest where fragments seldom repeat."""
        if self._ranks is None:
            return self.encode_batch(texts)
        return [np.array(self._whole(t), self.dtype) if any(s in t for s in self.special) else self._ranks.encode_to_numpy(t, disallowed_special=()).astype(self.dtype) for t in texts]

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode("utf-8")
        if len(data) < 2:
            return [data] if data else []
        raw = np.frombuffer(data, np.uint8)
        pairs = raw[:-1].astype(np.uint16) << 8
        pairs |= raw[1:]
        cuts = (np.flatnonzero(self.cut[pairs]) + 1).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]

    def _around_special(self, text: str) -> list[bytes]:
        """Fragments of what lies between special tokens, and these."""
        if not any(k in text for k in self.special):
            return self.fragments(text)
        out, at = [], 0
        for m in self._parts.finditer(text):
            out += [*self.fragments(text[at : m.start()]), m[0].encode()]
            at = m.end()
        return out + self.fragments(text[at:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Special tokens in a text are recognised as the library does by default."""
        if self._special_bytes and self._ranks is not None:
            return self._fragments.encode_batch(texts, (), self._around_special, self._whole)
        return self._fragments.encode_batch(texts, self.special, self.fragments, self._whole)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


class WordSplitBPE(_Library):
    """Encoder for a vocabulary whose tokens never span white space: words are encoded apart, each distinct one once."""

    def __init__(self, path: str, cache_bytes: int = 48_000_000):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = _dtype(spec["model"]["vocab"])
        self._find = regex.compile(WORD_PATTERN).findall
        self._piece = None
        end = spec["model"].get("end_of_word_suffix")
        if end and _ordered(spec["model"]["merges"], spec["model"]["vocab"], 512):
            # The end of a word becomes byte 255, which UTF-8 never uses. Ids 256 to 511 join it to each byte first.
            chars = byte_of_char()
            ranks = {}
            for token, i in spec["model"]["vocab"].items():
                if token not in self.special:
                    last = token.endswith(end)
                    ranks[bytes(chars[c] for c in token.removesuffix(end)) + b"\xff" * last] = i
            ranks[b"\xff"] = max(spec["model"]["vocab"].values()) + 1
            self._piece = _ranked(ranks, WORD_PATTERN)._core_bpe.encode_single_piece
        self._fragments = _Fragments(self.word, self.dtype, cache_bytes)

    def word(self, word: str) -> list[int]:
        """Ids of a text without white space. Latin words take the short way, all others the library's."""
        if self._piece is None or not (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word and "\x85" not in word and "\xa0" not in word)):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        low = word.lower()
        if low.isalpha():
            return self._piece(low.encode() + b"\xff")
        if low[:-1].isalpha() and low[-1] in ".,":
            return [*self._piece(low[:-1].encode() + b"\xff"), *self._piece(low[-1].encode() + b"\xff")]
        pieces = self._find(unicodedata.normalize("NFC", low))
        if len(pieces) == 1:
            return self._piece(pieces[0].encode() + b"\xff")
        return [i for p in pieces for i in self._piece(p.encode() + b"\xff")]

    @staticmethod
    def words(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Special tokens in a text are recognised as the library does by default."""
        return self._fragments.encode_batch(texts, self.special, self.words, self._whole)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_loaded: dict = {}
worker.cache(_loaded.clear)


def encoder(kind: type, path: str):
    """One encoder per Python worker and vocabulary file."""
    if (kind, path) not in _loaded:
        _loaded.clear()
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_decode(docs, path: str, *, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: doc_id, n_tokens, ids (binary, little-endian unsigned 32 bits), decoded.

    A null or empty text has no ids and decodes to the empty text. Rows are independent: repeated and
    null doc_ids are kept as they are, and equal texts have equal ids. Special tokens in a text are ids of their own,
    as in the library. Texts are taken whole, however long, some at a time; extra columns are ignored; an empty
    table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        worker.claim("encode")
        bpe = encoder(ForcedBoundaryBPE, path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                ids = bpe.encode_batch(texts[lo : lo + 500])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(ids)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
