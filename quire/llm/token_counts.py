"""Numbers of tokens of texts under several public tokenizers at once.

Byte-level vocabularies with one pattern share the cut into words; numbers of a word's tokens come
from a bounded cache. A sentencepiece model with no piece across white space is counted word by word
too; texts where that does not hold (runs of spaces, tabs, its own space sign) go through the model whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quire.llm.tokenize import CACHE_WORDS, byte_encoder


class _Cache(dict):
    """Counts of words; cleared when it is full."""

    def __init__(self, many: Callable[[list[str]], list[int]]):
        self.many = many

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if new:
            if len(self) + len(new) > CACHE_WORDS:
                self.clear()
                new = list(words)
            self.update(zip(new, self.many(new)))


def _piece_counts(path: str):
    """Counts of (first word, word after a space, text after a line feed) pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    many = lambda xs: [len(x) for x in model.encode(xs, num_threads=1)]
    base = len(model.encode("\n"))
    after_space = _Cache(lambda ws: many(ws))
    after_feed = _Cache(lambda ws: [n - base for n in many(["\n" + w for w in ws])])

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, rows = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "  " in t or t[0] == " " or t[-1] == " " or "▁" in t or "\n " in t or " \n" in t or "\t" in t or "\r" in t or t[0] == "\n":
                whole.append(i)
            else:
                rows.append((i, [x.split(" ") for x in t.split("\n")]))
        a = {w for _, r in rows for n, line in enumerate(r) for w in line[(n > 0) :] if w}
        b = {line[0] for _, r in rows for line in r[1:] if line[0]}
        after_space.learn(a)
        after_feed.learn(b)
        for i, r in rows:
            total = len(r) - 1
            for n, line in enumerate(r):
                if n:
                    if line[0]:
                        total += after_feed[line[0]]
                    line = line[1:]
                elif not line[0]:
                    line = line[1:]
                total += sum(map(after_space.__getitem__, line))
            out[i] = total
        for i, n in zip(whole, many([texts[i] for i in whole])):
            out[i] = n
        return out

    return count


_LOADED: dict[tuple, Callable] = {}


def counter(names: tuple[str, ...], folder: str | None = None) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to an array of numbers of tokens (rows: texts, columns: ``names``)."""
    if (names, folder) in _LOADED:
        return _LOADED[names, folder]
    import os

    import public_tokenizers as P

    where = lambda f: os.path.join(folder, f) if folder else P.path(f)
    byte_level = [n for n in names if os.path.exists(where(f"{n}.tiktoken"))]
    caches = {n: _Cache(lambda ws, e=byte_encoder(n, folder): [len(x) for x in e.words(ws)]) for n in byte_level}
    cut = byte_encoder(byte_level[0], folder).cut if byte_level else None
    others: dict[str, Callable] = {}
    for n in names:
        if n in caches:
            continue
        if os.path.exists(where(f"{n}.model")):
            others[n] = _piece_counts(where(f"{n}.model"))
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(where(f"{n}.json"))
            t.encode_special_tokens = True
            others[n] = lambda xs, t=t: [len(x.ids) for x in t.encode_batch(xs, add_special_tokens=False)]

    def count(texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out = np.zeros((len(texts), len(names)), dtype=np.int64)
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            if cut:
                words = [cut(t) for t in part]
                distinct = {w for ws in words for w in ws}
                for n, c in caches.items():
                    c.learn(distinct)
                    get = c.__getitem__
                    out[lo : lo + 256, names.index(n)] = [sum(map(get, ws)) for ws in words]
            for n, f in others.items():
                out[lo : lo + 256, names.index(n)] = f(part)
        return out

    _LOADED[names, folder] = count
    return count
