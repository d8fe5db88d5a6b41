"""Text that was decoded with a wrong character encoding: found, explained and restored.

A multinomial classifier over hashed byte bigrams is trained on clean words and on the same words
garbled synthetically along every chain of encodings below. In each line a best path through its
words (a switch of class costs) marks the stretches a chain garbled. The chain is inverted; a
stretch counts as recovered if the bytes decode strictly and the result reads like clean text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalikes import SAME_SHAPE

# The chains, as (true encoding, encoding it was read with) steps in order.
_OVER_UTF8 = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1256", "iso8859_6", "cp437", "cp850", "cp866")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *(((("utf-8", w),)) for w in _OVER_UTF8),
    *((("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1", "mac_roman") for b in ("cp1252", "latin-1", "mac_roman")),
    *(((("cp1256", w),)) for w in ("cp1252", "latin-1", "mac_roman", "cp1251", "iso8859_6", "cp437", "cp850", "utf-8")),
    *(((("iso8859_6", w),)) for w in ("cp1252", "mac_roman", "cp1251", "cp1256", "cp437", "utf-8")),
    *(((("cp1252", w),)) for w in ("mac_roman", "cp437", "cp850", "cp1251", "cp1256", "utf-8")),
    *(((("mac_roman", w),)) for w in ("cp1252", "utf-8")),
)
LOST = "�"


def _decoder(name: str) -> list[str]:
    """Character of each byte; bytes the encoding leaves open stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_DECODE = {n: _decoder(n) for n in {w for c in CHAINS for _, w in c if w != "utf-8"}}
_ENCODE = {}
for _n, _t in _DECODE.items():
    _m = {chr(b): b for b in range(0x80, 0xA0)}
    _m.update({c: b for b, c in enumerate(_t)})
    _ENCODE[_n] = _m


def garble(text: str, chain: tuple[tuple[str, str], ...], open_bytes: str = "keep") -> str:
    """Read ``text`` wrongly along the chain. Bytes the encoding leaves open stand for themselves
    (``keep``), become the replacement sign (``replace``) or are dropped (``ignore``)."""
    for true, wrong in chain:
        raw = text.encode(true, "replace")
        if wrong == "utf-8":
            text = raw.decode("utf-8", "replace")
        elif open_bytes != "keep":
            text = raw.decode(wrong, open_bytes)
        else:
            t = _DECODE[wrong]
            text = "".join([t[b] for b in raw])
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> tuple[str, bool, float]:
    """The text before the chain, whether every step decoded strictly, and which share of the signs
    beyond ASCII could be read. What could not be read is the replacement sign."""
    strict, share = True, 1.0
    for true, wrong in reversed(chain):
        if wrong == "utf-8":  # what UTF-8 could not read is gone
            return text, False, 0.0
        m = _ENCODE[wrong]
        codes = [m.get(c) for c in text]
        raw = bytes(0xFF if c is None else c for c in codes)
        high = sum(c > 127 for c in raw)
        gone = codes.count(None)
        text = raw.decode(true, "replace")
        if true == "utf-8":
            # a sequence of n bytes gives one sign, a byte that fails one replacement sign
            bad = text.count(LOST)
        else:
            bad = gone
            if gone:
                text = "".join([LOST if c is None else t for c, t in zip(codes, text)])
            bad = max(bad, text.count(LOST))
        if bad or gone:
            strict = False
            share *= 1 - min(1.0, bad / max(1, high))
    return text, strict, share


_BUCKETS = 1 << 16
#: What the class of a stretch must gain over clean; what its inversion must gain as clean text, in
#: all and for each bigram.
SURE, BETTER, BETTER_EACH = 4.0, 9.0, 2.5
#: Share of the signs beyond ASCII that must be readable for a stretch that does not decode strictly.
READABLE = 0.5
#: Bucket of all pairs of ASCII bytes, which say nothing about the encoding.
NEUTRAL = 0
#: Clean words have a class for each group of scripts, so that a script's share in the sample does not
#: count; the best one stands for clean.
_N_CLEAN = 3


def _script(word: str) -> int:
    """0 for words with Arabic letters, 1 with Greek or Cyrillic ones, 2 for others."""
    if any("\u0600" <= c <= "\u06ff" for c in word):
        return 0
    return 1 if any("\u0370" <= c <= "\u052f" for c in word) else 2




_INNER_SIGN = re.compile(r"[^\W\d_][^\w\s\x00-\x7f\u2010-\u2015\u2018-\u201f\u200b-\u200f\ufeff\u00ad\u00a0][^\W\d_]")
_ALIKE = {c for v in SAME_SHAPE.values() for c in v}


def _doubtful(word: str) -> bool:
    """Whether a word teaches nothing about clean text: a sign between letters, or among Latin letters Greek or
    Cyrillic ones that do not pass for Latin. In a garbled sample such words would stand for clean ones."""
    if _INNER_SIGN.search(word):
        return True
    other = [c for c in word if "\u0370" <= c <= "\u052f"]
    return bool(other) and any(c.isascii() and c.isalpha() for c in word) and not _ALIKE.issuperset(other)


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams of all words (with a space on either side), and where words start."""
    raw = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = np.cumsum(lens) - lens
    h = ((flat[:-1] * np.uint32(256) + flat[1:]) * np.uint32(40503)) & np.uint32(_BUCKETS - 1)
    h[(flat[:-1] | flat[1:]) < 128] = NEUTRAL
    keep = np.ones(len(h), dtype=bool)
    keep[starts[1:] - 1] = False  # the pair of one word's end and the next one's start
    return h[keep], starts - np.arange(len(raw))


@dataclass
class Classifier:
    """Log probabilities of bigram buckets by class: the clean classes, then one for each chain."""

    table: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (rows) along each chain (columns from 1) less that as clean text
        (column 0, zero)."""
        h, starts = _bigrams(words)
        s = np.add.reduceat(self.table[h], starts, axis=0)
        clean = s[:, :_N_CLEAN].max(axis=1, keepdims=True)
        return np.concatenate([np.zeros_like(clean), s[:, _N_CLEAN:] - clean], axis=1)


def _reads_as_utf8(word: str) -> bool:
    """Whether the bytes of a word form sequences of UTF-8, which clean words hardly ever do."""
    for chain in CHAINS[: len(_OVER_UTF8)]:
        back, _, share = invert(word, chain)
        if share >= READABLE and back != word:
            return True
    return False


def fit(lines: list[str], smooth: float = 0.05) -> Classifier:
    """Train on lines that are nearly all clean; lines the first fit finds garbled are left out of the
    second."""
    lines = [x for x in lines if not any(_reads_as_utf8(w) for w in x.split(" ") if not w.isascii())]
    model = None
    for _ in range(2):
        if model is not None:
            lines = [x for x in lines if not find_stretches(x, model, trust=True)]
        words = Counter(w for x in lines for w in x.split(" ") if w and not w.isascii())
        words = Counter({w: n for w, n in words.items() if not _doubtful(w)})
        groups = [{w: n for w, n in words.items() if _script(w) == i} for i in range(_N_CLEAN)]
        for chain in CHAINS:
            bad = Counter()
            for w, n in words.items():
                for g in {garble(w, chain, x) for x in ("keep", "replace", "ignore")}:
                    if g not in words and g.strip("?"):
                        bad[g] += n
            groups.append(bad)
        counts = np.full((_BUCKETS, _N_CLEAN + len(CHAINS)), smooth, dtype=np.float64)
        for i, g in enumerate(groups):
            if g:
                h, starts = _bigrams(list(g))
                times = np.repeat(np.fromiter(g.values(), dtype=np.float64), np.diff(np.r_[starts, len(h)]))
                counts[:, i] += np.bincount(h, weights=times, minlength=_BUCKETS)
        counts[NEUTRAL] = 0
        with np.errstate(divide="ignore"):
            counts /= counts.sum(axis=0)
        counts[NEUTRAL] = 1
        model = Classifier(np.log(counts).astype(np.float32))
    return model


#: Costs of a path: into a garbled stretch, out of it, from one chain to another (log scale).
ENTER, LEAVE, CHANGE = 5.0, 3.0, 9.0
#: Words with less evidence than this against clean do not start a search.
ODD = 3.0
CACHE_WORDS = 300_000


def _word_scores(words: list[str], model: Classifier) -> list[np.ndarray | None]:
    """Scores of words against class 0; None for words no class beats clean in."""
    cache = model.cache
    new = list({w for w in words if w not in cache})
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(set(words))
        s = model.scores(new)
        odd = s.max(axis=1) > ODD
        for i, w in enumerate(new):  # a lone sign such as a dash tells nothing
            cache[w] = s[i].copy() if odd[i] and (len(w) > 2 or any(map(str.isalnum, w)) or LOST in w) else None
    return [cache[w] for w in words]


def _path(s: np.ndarray) -> np.ndarray:
    """Best class of each word: emissions ``s`` (clean is 0), switches cost."""
    n, c = s.shape
    back = np.zeros((n, c), dtype=np.int32)
    v = s[0].astype(np.float64).copy()
    v[1:] -= ENTER
    for t in range(1, n):
        g = int(np.argmax(v[1:])) + 1
        to_clean = v[g] - LEAVE
        enter, change = v[0] - ENTER, v[g] - CHANGE
        stay = v.copy()
        other = max(enter, change)
        src = 0 if enter >= change else g
        new = np.where(stay >= other, stay, other)
        back[t] = np.where(stay >= other, np.arange(c), src)
        new[0], back[t, 0] = (v[0], 0) if v[0] >= to_clean else (to_clean, g)
        v = new + s[t]
    out = np.empty(n, dtype=np.int32)
    out[-1] = int(np.argmax(v))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


@dataclass
class Stretch:
    first: int  # words, inclusive
    last: int
    chain: int
    restored: str | None


def _clean_fit(text: str, model: Classifier) -> tuple[float, int]:
    """Log likelihood of ``text`` as clean words and its number of bigrams, signs that were lost aside."""
    words = [w for w in text.replace(LOST, " ").split(" ") if w and not w.isascii()]
    if not words:
        return 0.0, 0
    h, starts = _bigrams(words)
    return float(np.add.reduceat(model.table[h, :_N_CLEAN], starts, axis=0).max(axis=1).sum()), int((h != NEUTRAL).sum())


_MIXED = re.compile("[\u0620-\u06d3][\u064b-\u065f]*[A-Za-z\u00c0-\u024f]|[A-Za-z\u00c0-\u024f][\u0620-\u06d3]")


def _reads_better(before: str, after: str, model: Classifier, proven: bool = False) -> bool:
    """Whether a stretch reads better inverted. Sequences of UTF-8 that all decode are ``proven``: they need not gain
    for each bigram, as a single quotation mark or number cannot."""
    if len(_MIXED.findall(after)) > len(_MIXED.findall(before)):  # no clean word holds Arabic and Latin letters
        return False
    (a, n), (b, m) = _clean_fit(before, model), _clean_fit(after, model)
    return b > a + BETTER and (proven or b / max(1, m) > a / max(1, n) + BETTER_EACH)


def _borders_clean(words: list[str], first: int, last: int) -> bool:
    """Whether a stretch of Greek or Cyrillic words has such a word beside it that reads clean: a chain
    of single bytes would have reached it too."""
    if not any(_script(w) == 1 for w in words[first : last + 1]):
        return False
    beside = words[max(0, first - 1) : first] + words[last + 1 : last + 2]
    return any(_script(w) == 1 for w in beside)


def find_stretches(line: str, model: Classifier, trust: bool = False) -> list[Stretch]:
    """Garbled stretches of a line (words are cut at plain spaces), with the text restored if it can be.
    ``trust`` takes the classifier's word where the inversion reads no better."""
    words = line.split(" ")
    own = _word_scores([w for w in words if w], model)
    if not any(x is not None for x in own):
        return []
    at = [i for i, w in enumerate(words) if w]
    full = list(own)
    if any(x is None for x in full):
        miss = [words[i] for i, x in zip(at, full) if x is None]
        rows = iter(np.minimum(model.scores(miss), 0))
        full = [x if x is not None else next(rows) for x in full]
    s = np.vstack(full)
    path = _path(s)
    out, t = [], 0
    while t < len(at):
        if path[t] == 0:
            t += 1
            continue
        u = t
        while u + 1 < len(at) and path[u + 1] == path[t]:
            u += 1
        stretch = " ".join(words[at[t] : at[u] + 1])
        gain = s[t : u + 1].sum(axis=0)
        found = None
        for c in np.argsort(-gain):
            if c == 0 or gain[c] < SURE:
                break
            chain = CHAINS[c - 1]
            if chain[-1][1] == "utf-8":
                found = found or (LOST in stretch and Stretch(at[t], at[u], int(c) - 1, None)) or None
                continue
            back, strict, share = invert(stretch, chain)
            whole = strict or chain[0][0] == "utf-8" or LOST in stretch
            if back != stretch and whole and share >= READABLE and _reads_better(stretch, back, model, strict and chain[0][0] == "utf-8"):
                if strict:
                    found = Stretch(at[t], at[u], int(c) - 1, back)
                    break
                found = found or Stretch(at[t], at[u], int(c) - 1, None)
        if found and CHAINS[found.chain][0][0] != "utf-8" and _borders_clean(words, at[t], at[u]):
            found = None
        if found or (trust and gain[path[t]] >= 4 * SURE):
            out.append(found or Stretch(at[t], at[u], int(path[t]) - 1, None))
        t = u + 1
    return out


def restore(line: str, found: list[Stretch]) -> str:
    """The line with its recovered stretches in place; stretches beyond recovery stay as they are."""
    words = line.split(" ")
    for f in reversed(found):
        if f.restored is not None:
            words[f.first : f.last + 1] = [f.restored]
    return " ".join(words)


def chain_name(chain: int) -> str:
    return ", ".join(f"{a} as {b}" for a, b in CHAINS[chain])


def train(blocks: DataFrame, sample: int = 12_000, longest: int = 2000) -> Classifier:
    """Fit on a bounded sample: of the lines with Arabic letters and of the others (ASCII aside, which says nothing
    about encodings) ``sample`` distinct lines each with the least hashes, none over ``longest`` characters.

    Lines whose hash is above about twice the wanted share are dropped where they are read, so that
    what reaches the driver does not grow with the table. Every line is classified, whatever its length.
    """
    lines = blocks.select(F.explode("lines").alias("line")).where(F.length("line") <= longest).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    arabic = F.col("line").rlike("[\u0600-\u06ff]")
    n = {r[0]: r[1] for r in lines.groupBy(arabic).agg(F.approx_count_distinct("line")).collect()}  # repeats fill no sample
    rows = []
    for group, count in sorted(n.items()):
        share = min(1.0, 2 * sample / max(1, count))
        near = F.xxhash64("line") < int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)
        rows += lines.where((arabic == group) & near).distinct().orderBy(F.xxhash64("line"), "line").limit(sample).collect()
    return fit([r.line for r in rows])


def garbled_lines(blocks: DataFrame, model: Classifier) -> DataFrame:
    """``block_id, line_no, line, restored, chain, recovered`` of each line garbled wholly or in part.

    ``recovered`` tells whether all garbled stretches were restored. Null and empty lines are no cases;
    repeated rows give one row.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(model.table)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Classifier(shared.value)
        for b in batches:
            lists = [[] if x is None else [y or "" for y in x] for x in b["lines"]]
            _word_scores([w for ws in {y for x in lists for y in x} for w in ws.split(" ") if w], m)
            rows = []
            for i, x in zip(b.block_id, lists):
                for n, line in enumerate(x):
                    if line.isascii() or not (f := find_stretches(line, m)):
                        continue
                    chains = "; ".join(dict.fromkeys(chain_name(y.chain) for y in f))
                    rows.append((i, n, line, restore(line, f), chains, all(y.restored is not None for y in f)))
            yield pd.DataFrame(rows, columns=["block_id", "line_no", "line", "restored", "chain", "recovered"])

    return (
        blocks.where("block_id IS NOT NULL").select("block_id", "lines")
        .mapInPandas(run, "block_id long, line_no int, line string, restored string, chain string, recovered boolean")
        .distinct()
    )
