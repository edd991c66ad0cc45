"""Encoding texts with a public byte-level BPE vocabulary.

The distinct words of a batch of texts lie as symbols in one flat array. Each round finds the rank
of every neighbouring pair by binary search over the sorted pair keys of the vocabulary, and every
word merges its lowest-ranked pair everywhere; words without a pair leave the array. Encoded words
are kept in a bounded cache per worker. Null and empty texts have no ids; special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import bounded_batches

TOKENIZERS = os.environ.get("QUARRYMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published splitting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker, and the longest word kept (characters).
CACHE_WORDS, CACHE_CHARS = 200_000, 40
#: Characters of text whose words are encoded together.
BATCH_CHARS = 2_000_000
NONE = np.int64(1) << 40


class ByteBpe:
    """A vocabulary of byte strings with ranks, as read from a ``.tiktoken`` rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        keys, made = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]
        self.cache: dict[str, np.ndarray] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by rounds of merges over all words at once."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
        while len(symbols):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NONE)
            rank[:-1][same] = self._ranks(symbols[:-1][same], symbols[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, first)
            ends = np.r_[first[1:], len(symbols)]
            over = lowest == NONE
            for f, e in zip(first[over], ends[over], strict=True):
                done[owner[f]] = symbols[f:e].astype(np.int32)
            live = np.repeat(~over, ends - first)
            if not live.any():
                break
            low = np.repeat(lowest, ends - first)[live]
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            hit = rank == low
            # of pairs that overlap (runs of one symbol) every second one merges, from the left
            at = np.flatnonzero(hit)
            run = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = rank[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text, as int32 arrays."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        cache = self.cache
        new = list({w for ws in cut for w in ws if w not in cache})
        local = dict(zip(new, self.merge([w.encode("utf-8", "replace") for w in new]), strict=True)) if new else {}
        empty = np.empty(0, dtype=np.int32)
        out = []
        for ws in cut:
            out.append(np.concatenate([local[w] if w in local else cache[w] for w in ws]) if ws else empty)
        if len(cache) < CACHE_WORDS:
            cache.update((w, v) for w, v in list(local.items())[: CACHE_WORDS - len(cache)] if len(w) <= CACHE_CHARS)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    """One instance per worker process and file."""
    return ByteBpe(path)


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive stretches of about ``most`` in total size, at least one element each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes):
        yield slice(start, len(sizes))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per input row; a map without any shuffle."""
    path = f"{directory or TOKENIZERS}/{name}.tiktoken"
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in slices(np.array([len(t or "") for t in texts]), BATCH_CHARS):
                ids = bpe.encode_batch(texts[part])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0)[part], lists], names=["doc_id", "ids"])

    return bounded_batches(source).mapInArrow(encode, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` by the same encoder."""
    return encode_texts(df, id_col, text_col, name, directory).select("doc_id", F.size("ids").alias("n_tokens"))
