"""Pages of repeated keywords, link lists or product tags instead of sentences.

Each line is cut into segments and each segment reduced to a shape: what kind of word it holds
(links, tags, codes, words), how many, with capitals or not, how it ends, which separator its line is cut at and
whether it has any of the language's commonest words, without which there are no sentences. Segments of
one shape form a group; a document is flagged if groups of a few shapes that are no sentences hold more than
half of its characters. Groups are made where a document is read and compared as columns: nothing is moved.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.lookalikes import SAME_SHAPE

LINK = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|</a>", re.I)
_MARKDOWN = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)")
_ANCHOR = re.compile(r"<a\s[^>]*>[^<\n]*</a>", re.I)
_TAG = re.compile(r"#\w+")
_CODE = re.compile(r"\b[A-Z]{1,5}-?\d{2,}\b|-?\d+\s?%|★+☆*")
_CODED = re.compile(r"[\d★]")
_SEPARATORS = re.compile(r"\s[|*/•·»>–—-]\s|[;؛,،]\s*|\s\|\s?|\t")
_SENTENCE = re.compile(r"(?<=[.!?؟。])\s+")
_EDGE = ".,;:!?؟،؛«»\"“”„()[]*|/»-–—…"

#: Commonest words of a language: those with this share of the rate of its tenth commonest word ...
COMMON_RATE = 0.5
#: ... of which at most so many are kept for a language.
MAX_COMMON = 60
#: Different words a text needs to count in full for its language; rate from which on a word of one text is damped.
VARIED, DAMPED = 15, 0.2
#: Segments a shape needs to count as a group, and words from which one segment is enough.
GROUP, PILE = 3, 12
#: Shapes that together must hold the share: pages of many shapes are no piles.
FEW = 4
#: A pair of words, not both of them common, is repeated from so many times on, and from this share of the words on.
REPEATS, REPEAT_SHARE = 4, 0.02


class _Plain(dict):
    """Characters for comparing words: compatibility forms, no marks, no invisible characters."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in "\n\t":
            out = ch
        else:
            out = "".join(
                c for c in unicodedata.normalize("NFKC", ch) if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf" and c != "ـ"
            )
        self[code] = out
        return out


_PLAIN = _Plain({ord(v): k for k, vs in SAME_SHAPE.items() for v in vs})


def plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text).translate(_PLAIN)


def _word_rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rates: Counter = Counter()
        for lang, text in zip(b.lang, b.text):
            words = plain(text).lower().split()
            counts = Counter(words)
            weight = min(1.0, len(counts) / VARIED)  # piles of few words say little about the language
            for w, n in counts.items():
                if w.isalpha():
                    rate = n / len(words)
                    rates[lang, w] += weight * rate / (1 + (rate / DAMPED) ** 2)
        rows = [(k[0], k[1], v) for k, v in rates.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "rate"])


def common_words(documents: DataFrame) -> set[str]:
    """The commonest words of each language of ``documents`` (null is one of them), over all rows.

    Texts of fewer than ``VARIED`` different words count in proportion, and a word that fills much of one
    text counts for less there; of a language ``MAX_COMMON`` words are kept at most."""
    rates = (
        documents.where("text IS NOT NULL")
        .select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
        .mapInPandas(_word_rates, "lang string, word string, rate double")
        .groupBy("lang", "word")
        .agg(F.sum("rate").alias("rate"))
    )
    ranked = rates.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "word"))).where(
        F.col("r") <= MAX_COMMON
    )
    top: dict[str, list] = {}
    for row in ranked.orderBy("lang", "r").collect():
        top.setdefault(row.lang, []).append((row.word, row.rate))
    return {w for rows in top.values() for w, rate in rows if rate >= COMMON_RATE * rows[min(9, len(rows) - 1)][1]}


class Words(dict):
    """What is known of a word as written: its plain form in lower case (empty for numbers and signs), whether
    it has a capital, and whether it is one of the commonest."""

    def __init__(self, common: set[str]):
        self.common = common

    def __missing__(self, word: str) -> tuple[str, bool, bool]:
        if len(self) > 200_000:
            self.clear()
        bare = word.strip(_EDGE)
        low = bare.lower()
        known = (low, bare[0].isupper(), low in self.common) if bare and not bare.isdigit() else ("", False, False)
        self[word] = known
        return known


def _cut(line: str, words: Words) -> tuple[list[str], str]:
    """Segments of a line, items where it is a list, else sentences; and the separator of its items."""
    items = [x for x in _SEPARATORS.split(line) if x.strip()]
    if len(items) >= 4:
        own = [x.split() for x in items]
        if sum(map(len, own)) <= 4.5 * len(items):
            bare = sum(not any(words[w][2] for w in x) for x in own)
            if bare >= 0.7 * len(items) or 2 * len(set(items)) <= len(items):
                often = Counter(x.strip() or "tab" for x in _SEPARATORS.findall(line))
                return items, max(sorted(often), key=often.get)
    return [x for x in _SENTENCE.split(line) if x.strip()], ""


def shape(segment: str, words: Words, separator: str = "", links: bool = True, codes: bool = True) -> tuple[str, bool]:
    """Shape of a segment, and whether it can be a sentence. ``links`` and ``codes`` tell whether there may be any."""
    n_links = len(LINK.findall(segment)) if links else 0
    tags = len(_TAG.findall(segment)) if "#" in segment else 0
    n_codes = len(_CODE.findall(segment)) if codes else 0
    letters = [x for x in map(words.__getitem__, segment.split()) if x[0]]
    n, capitals, common = len(letters), sum(x[1] for x in letters), sum(x[2] for x in letters)
    size = "0" if n == 0 else "1-2" if n <= 2 else "3-5" if n <= 5 else "6-12" if n <= 12 else "13+"
    caps = "C" if 2 * capitals > n else "c"
    end = "." if segment.rstrip()[-1:] in ".!?؟:" else ""
    kind = "link" if n_links else "tag" if tags else "code" if n_codes else "word"
    sentence = kind != "link" and tags * 2 < max(1, n) and common / max(1, n) >= (0.05 if n > 3 else 0.2) and not (n_codes and n <= 4)
    return f"{kind} {size} {caps}{end}{separator and ' ' + separator} {'s' if sentence else 'x'}", sentence


def _link_chars(segment: str) -> int:
    return sum(len(m) for p in (_ANCHOR, _MARKDOWN, LINK) for m in p.findall(segment))


def shape_groups(text: str, words: Words) -> tuple[int, dict[str, list[int]]]:
    """Characters of a text (white space aside), and of each shape that is no sentence segments and characters."""
    text = plain(text)
    lines = [x for x in text.split("\n") if x.strip()]
    total = sum(len(x) - x.count(" ") for x in lines)
    groups: dict[str, list[int]] = {}
    if not total:
        return 0, groups
    low = text.lower()
    links, codes = any(x in low for x in ("://", "www.", "<a", "</a")), _CODED.search(text) is not None
    times = Counter(lines)
    own = [x for w in text.split() if (x := words[w][0])]
    floor = max(REPEATS, REPEAT_SHARE * len(own))
    pairs = Counter(zip(own, own[1:]))
    again = {p for p, n in pairs.items() if n >= floor and not words.common.issuperset(p)}
    cut = [(line, *_cut(line, words)) for line in lines]
    often = Counter(seg for _, segs, _ in cut for seg in segs)
    for line, segs, separator in cut:
        for seg in segs:
            name, sentence = shape(seg, words, separator, links, codes)
            size, n_words = len(seg) - seg.count(" "), seg.count(" ") + 1
            if sentence and n_words <= 3 and often[seg] >= REPEATS:
                sentence, name = False, "again " + name
            if sentence:
                if not again or (times[line] > 1 and 4 <= n_words <= 20):
                    continue  # a burden is a sentence, however often it comes
                mine = [x for w in seg.split() if (x := words[w][0])]
                hit = [p in again for p in zip(mine, mine[1:])]
                marked = sum(len(w) for i, w in enumerate(mine) if (i < len(hit) and hit[i]) or (i and hit[i - 1]))
                if marked < 0.4 * size:
                    continue
                name = "repeated " + name
                n_words = PILE  # already counted by its repeats
            elif name.startswith("link"):
                bare = LINK.sub(" ", seg)
                if sum(words[w][2] for w in bare.split()) >= 2:
                    size = _link_chars(seg)  # a sentence with references
            g = groups.setdefault(name, [0, 0])
            g[0] += GROUP if n_words >= PILE else 1
            g[1] += size
    return total, groups


def document_shapes(documents: DataFrame, common: set[str] | None = None) -> DataFrame:
    """``doc_id, total, groups`` (``array<struct<shape, n, chars>>``) of the documents that have a segment which is no
    sentence. Null, empty and blank texts have none; each row is looked at by itself."""
    known = common_words(documents) if common is None else common
    shared = documents.sparkSession.sparkContext.broadcast(known)  # at most MAX_COMMON words a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for b in batches:
            rows = ((i, *shape_groups(t, words)) for i, t in zip(b.doc_id, b.text))
            kept = [(i, n, list(g), *map(list, zip(*g.values()))) for i, n, g in rows if g]
            yield pd.DataFrame(kept, columns=["doc_id", "total", "shapes", "n", "chars"])

    found = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(
        run, "doc_id long, total long, shapes array<string>, n array<long>, chars array<long>"
    )
    return found.select("doc_id", "total", F.arrays_zip(F.col("shapes").alias("shape"), "n", "chars").alias("groups"))


def spam_documents(documents: DataFrame, common: set[str] | None = None, over: float = 0.5) -> DataFrame:
    """``doc_id, share, shape`` of the documents in which at most ``FEW`` shapes that are no sentences hold more than
    ``over`` of the characters; ``shape`` is the largest. Null, empty and blank texts are never flagged."""
    groups = F.filter("groups", lambda g: g["n"] >= GROUP)
    largest = F.slice(F.sort_array(F.transform(groups, lambda g: F.struct(g["chars"].alias("chars"), g["shape"].alias("shape"))), asc=False), 1, FEW)
    share = F.aggregate("_g", F.lit(0).cast("long"), lambda n, g: n + g["chars"]) / F.col("total")
    found = document_shapes(documents, common).withColumn("_g", largest).withColumn("share", share)
    return found.where(F.col("share") > over).select("doc_id", "share", F.get("_g", F.lit(0))["shape"].alias("shape"))
