"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pretoken exactly one vocabulary token can end its
encoding. An automaton over the vocabulary lists the tokens that end at each
offset; the one whose left neighbour (the last token of the prefix before it)
it may legally follow is stored, and following these back from the end emits
the ids. Two tokens may stand side by side when no merge across their border
would come before the merges that build them. No merge loop runs.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import keyed

#: Words kept in a worker's memory; beyond it they are encoded again (the result is the same).
CACHE_WORDS = 800_000
CACHED_LENGTH = 64
# The characters that stand for bytes in the vocabulary's file.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CHAR_OF = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
# The split pattern of byte-level vocabularies, written out for the
# characters of COMMON. A text with others is split by the file's own splitter,
# as Unicode tables differ by version.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t\\n\\v\\f\\r "
PATTERN = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                     rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
RARE = re.compile("[^\\t\\n\\v\\f\\r\\x20-\\x7e¡-ɏ‐-‧‰-⁞€]")


PACK = [struct.Struct(f"<{n}I").pack for n in range(9)]


class _Words(dict):
    """Pretoken -> its ids as little-endian bytes, encoded when first seen."""

    def __init__(self, bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.encode_piece(word.encode())
        packed = np.array(ids, "<u4").tobytes() if len(ids) > 8 else PACK[len(ids)](*ids)
        if len(word) <= CACHED_LENGTH:
            self[word] = packed
            self.bpe.texts[packed] = b"".join([self.bpe.bytes_of[i] for i in ids])
        return packed


class _Texts(dict):
    """Packed ids -> the bytes that they stand for."""

    def __init__(self, bpe):
        self.bpe = bpe

    def __missing__(self, packed: bytes) -> bytes:
        return b"".join([self.bpe.bytes_of[i] for i in struct.unpack(f"<{len(packed) // 4}I", packed)])


class PrefixBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in CHAR_OF.items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        # merge order of a token (bytes: before all), the parts that make it, and the order of a pair's merge
        self.order: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            if made not in self.parts:
                self.parts[made], self.order[made] = (vocab[a], vocab[b]), rank
        self.ends = ahocorasick.Automaton()
        for token in vocab.values():
            if token not in self.special.values():
                text = self.bytes_of[token].decode("latin-1")
                self.ends.add_word(text, (len(text), token))
        self.ends.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words, self.texts = _Words(self), _Texts(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens.

        Undo the merges of both from the latest to the first, keeping the tokens
        at the border. A merge across the border would have happened if it comes
        before the merge undone last (from the left, at equal order)."""
        key = left << 32 | right
        before = len(self.merge)  # merges from here on cannot have been made
        fits = True
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < before:
                fits = False
                break
            lo, ro = self.order[left], self.order[right]
            if lo < 0 and ro < 0:
                break
            if lo > ro:
                left, before = self.parts[left][1], lo
            elif lo < ro:
                right, before = self.parts[right][0], ro + 1
            else:  # the same token twice: merges run from the left
                right, before = self.parts[right][0], ro + 1
        if len(self.fits) > 2 * CACHE_WORDS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        n = len(piece)
        last = [-1] * (n + 1)  # the token that ends the encoding of each prefix
        size = [0] * (n + 1)
        known = self.fits.get
        for at, (length, token) in self.ends.iter(piece.decode("latin-1")):
            if last[at + 1] < 0:
                if length <= at:
                    left = last[at + 1 - length]
                    if left < 0 or not (fits if (fits := known(left << 32 | token)) is not None
                                        else self.compatible(left, token)):
                        continue
                last[at + 1] = token
                size[at + 1] = length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def pretokens(self, text: str) -> list[str]:
        if not RARE.search(text):
            return PATTERN.findall(text)
        at = self.splitter.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in at]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids of a text, and the bytes that they decode to."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.texts.clear()
        packed: list[bytes] = []
        for part in self.split_special.split(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                packed.append(struct.pack("<I", self.special[part]))
            elif part:
                packed.extend(map(self.words.__getitem__, self.pretokens(part)))
        return b"".join(packed), b"".join(map(self.texts.__getitem__, packed))


@lru_cache(maxsize=2)
def loaded(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of each row: ids as little-endian unsigned 32-bit
    integers in one binary value, and the text decoded from them again.

    Special tokens in a text become their ids; a null text is empty (no ids); an
    empty table gives an empty one; repeated rows repeat. Each row is encoded in
    its own task with no shuffle. The file at ``tokenizer_path`` must be readable
    on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            done = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d[0] for d in done], pa.binary()),
                 pa.array([d[1].decode("utf-8", "replace") for d in done], pa.string())], ["doc_id", "ids", "decoded"])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
