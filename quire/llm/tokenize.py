"""Byte-pair encoding of whole tables with a public vocabulary.

Words of a batch of texts are cut out by the vocabulary's pattern, each distinct word once. Their
bytes lie in one flat array of symbols; a round looks every neighbouring pair up in the sorted
array of pair keys by binary search, merges in each word the pair of lowest rank (left to right,
without overlap) and compacts the array, until no word has a pair left. Words already seen come
from a bounded cache.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words an encoder keeps between batches; beyond them words are encoded anew.
CACHE_WORDS = 200_000


class Encoder:
    """Ids of texts under a table of byte strings in merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.cut = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, out = [], [], []
        for token, rank in ranks.items():  # every way to make a token of two others is a merge of its rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        key = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_id = key[order], np.array(out, dtype=np.int64)[order]
        self.cache: dict[str, np.ndarray] = {}

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all of them."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), lens)
        done_sym, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(sym) > 1:
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where((self.pair_key[at] == key) & (word[:-1] == word[1:]), self.pair_id[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best != none, sizes)
            if not live.all():  # words without a pair are ready
                done_sym.append(sym[~live]), done_word.append(word[~live])
                keep = np.flatnonzero(live)
                if not len(keep):
                    sym, word = sym[:0], word[:0]
                    break
                rank = np.r_[rank, none][keep][:-1]
                sym, word = sym[keep], word[keep]
                best, sizes = best[best != none], sizes[best != none]
            hit = rank == np.repeat(best, sizes)[:-1]
            hit &= word[:-1] == word[1:]
            pos = np.flatnonzero(hit)
            # runs of overlapping hits (aaa): take every other one
            run = np.cumsum(np.r_[True, np.diff(pos) != 1]) - 1
            first = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
            pos = pos[(pos - pos[first][run]) % 2 == 0]
            sym[pos] = rank[pos]
            keep = np.ones(len(sym), dtype=bool)
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        done_sym.append(sym), done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym = sym[order].astype(np.int32)
        return np.split(sym, np.cumsum(np.bincount(word, minlength=len(raw)))[:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.cut(t) if t else [] for t in texts]
        local = self.cache
        new = list({w for ws in cut for w in ws if w not in local})
        fresh: dict[str, np.ndarray] = {}
        if new:
            fresh = dict(zip(new, self.words(new)))
            if len(local) + len(fresh) <= CACHE_WORDS:
                local.update(fresh)
                fresh = {}
        none = np.empty(0, dtype=np.int32)
        if fresh:
            get = lambda w: local[w] if w in local else fresh[w]
        else:
            get = local.__getitem__
        return [np.concatenate([get(w) for w in ws]) if ws else none for ws in cut]


@lru_cache(maxsize=4)
def byte_encoder(name: str, folder: str | None = None) -> Encoder:
    """Encoder of a ``.tiktoken`` file: of the installed vocabularies, or of ``folder``."""
    import public_tokenizers as P

    path = f"{folder}/{name}.tiktoken" if folder else P.path(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, P.PATTERN)


def ids(col: Column | str, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Token ids of a text column as array<int>, without special tokens; [] for null and empty."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(s: pd.Series) -> pd.Series:
        enc = byte_encoder(name, folder)
        out: list[np.ndarray] = []
        texts = s.tolist()
        at = 0
        while at < len(texts):  # a batch of about a million characters at a time
            size, to = 0, at
            while to < len(texts) and (size < 1_000_000 or to == at):
                size += len(texts[to] or "")
                to += 1
            out += enc.encode(texts[at:to])
            at = to
        return pd.Series(out, dtype=object)

    return encode(col)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row per row of ``documents``; special-token strings are ordinary text."""
    return documents.select("doc_id", ids("text", name, folder).alias("ids"))
