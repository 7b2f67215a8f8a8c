"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8).

Words are cut by the tokenizer's own pattern. Each word is encoded over a doubly linked list of
symbols with a priority queue of merge ranks; queue entries whose symbols have changed since are
skipped. A bounded cache keeps the ids of recent words, so a word's merges are done once a worker.
The vocabulary is read from its file on each worker, never shipped through the driver.

Defined cases: a null or empty text gives an empty list; a blank text gives the ids of its white
space; strings of special tokens in a text are ordinary text; unpaired surrogates are encoded as
U+FFFD; ties in rank go to the leftmost pair; repeated rows are encoded alike and all kept, as are rows
without a key.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept in a worker's cache, and the longest word kept.
CACHE_WORDS, CACHE_BYTES = 200_000, 64


def default_vocabulary() -> str:
    """The path of the vocabulary byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    """The pattern that cuts text into words for that vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Bpe:
    """A byte-level BPE encoder and decoder over a file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.strings = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        # Symbols are the spans [start, end) of the word; symbol i is live while end[i] > 0.
        end = list(range(1, n + 1))
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or nxt[i] != j or end[j] != stop:
                continue  # stale: one of the two has been merged since
            end[i], end[j] = stop, 0
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (h := prv[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for word in self.find(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode() if any("\ud800" <= c <= "\udfff" for c in word) else word.encode())
                if len(word) <= CACHE_BYTES:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by joining their vocabulary strings."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Bpe:
    """One encoder a worker process."""
    return Bpe(path, pattern)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The key and the ids of each row, in one narrow pass: key, ids."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [bpe.encode(t) for t in b[text]]})

    # The key goes through Python as text, so that a null beside it can't cost a large number its last digits.
    return docs.select(F.col(key).cast("string").alias(key), F.col(text)).mapInPandas(run, f"`{key}` string, ids array<int>").select(F.col(key).cast(kind).alias(key), "ids")


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The number of tokens of each row beside the columns ``keys``: keys, n_tokens."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for b in batches:
            yield b[keys].assign(n_tokens=[len(bpe.encode(t)) for t in b[text]])

    part = docs.select(*(F.col(k).cast("string").alias(k) for k in keys), *([] if text in keys else [text]))
    schema = ", ".join(f"`{k}` string" for k in keys)
    return part.mapInPandas(run, f"{schema}, n_tokens long").select(*(F.col(k).cast(docs.schema[k].dataType).alias(k) for k in keys), "n_tokens")
