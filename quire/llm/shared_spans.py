"""Long exact spans shared between records.

Every window of ``length`` characters has a Rabin-Karp hash; a window that occurs in two records is
shared, and shared windows merge into maximal intervals. So as not to move a hash per character,
a first pass keeps of each text the hashes of half windows that are least among their neighbours:
a choice by content alone, of which every window of ``length`` holds at least one, so two equal
windows hold the same. Only windows around a kept hash that occurs in two texts are hashed (128
bits) and counted. The result is the same as with all windows counted.

Records with one text between them count once in both passes and are shared throughout. What counts
is in how many records a window stands: two texts under one key are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.asof import overlap_join
from quire.session import checkpoint

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolling_hashes(text: str, k: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, then scattered) of each window of ``k`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        values = _mix(codes + _U(1))
        powers = _powers(base, n)
        sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(values * powers, dtype=_U)])
        inverse = _U(pow(int(base), -1, 1 << 64))  # brings every window to the power 0
        return _mix((sums[k:] - sums[:-k]) * _powers(inverse, n - k + 1))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=_U), np.full(n - 1, base, dtype=_U)]), dtype=_U)


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each ``w`` neighbours, from running values of blocks forwards and backwards."""
    n = len(x)
    pad = np.full(-n % w, fill, dtype=x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def kept_hashes(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the half windows least among ``length - k + 1`` neighbours."""
    k = length // 2
    h = rolling_hashes(text, k)
    w = length - k + 1
    if len(h) < w:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
    least = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    zero = np.zeros(w - 1, dtype=_U)
    most = _sliding(np.concatenate([zero, least, zero]), w, np.maximum, 0)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _prints(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, tids = [], []
            for t, x in zip(b.tid, b.text):
                h = np.unique(kept_hashes(x, length)[1])
                fps.append(h)
                tids.append(np.full(len(h), t, dtype=np.int64))
            if fps:
                yield pd.DataFrame({"fp": np.concatenate(fps).view(np.int64), "tid": np.concatenate(tids)})

    return run


def _windows(length: int):
    k = length // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tid, owner, x, shared in zip(b.tid, b.owner, b.text, b.fps):
                at, h = kept_hashes(x, length)
                at = at[np.isin(h.view(np.int64), np.asarray(shared, dtype=np.int64))]
                if not len(at):
                    continue
                n = len(x) - length + 1
                edge = np.zeros(n + 1, dtype=np.int32)
                np.add.at(edge, np.maximum(at - (length - k), 0), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                start = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                yield pd.DataFrame(
                    {
                        "h1": rolling_hashes(x, length)[start].view(np.int64),
                        "h2": rolling_hashes(x, length, _BASES[1])[start].view(np.int64),
                        "tid": tid,
                        "owner": owner,
                        "start": start.astype(np.int32),
                    }
                )

    return run


def shared_spans(records: DataFrame, keys: list[str], text: str, length: int = 120) -> DataFrame:
    """``*keys, span_start, span_end`` of each maximal stretch of a text all of whose characters lie
    in a string of ``length`` characters that also occurs in a record with other keys.

    Places count characters from 0, ends are exclusive; overlapping or touching stretches are one.
    Null texts and texts shorter than ``length`` have none. Repeated rows of one record are one
    record; two texts under the same keys are not others of each other unless another record has them.
    """
    rows = records.where(F.col(text).isNotNull() & (F.length(text) >= length)).select(
        *keys, F.xxhash64(*keys).alias("sid"), F.xxhash64(text).alias("tid"), F.col(text).alias("text")
    )
    heads = checkpoint(rows.select(*keys, "sid", "tid", F.length("text").alias("n")).distinct())
    by_text = heads.groupBy("tid").agg(F.min("sid").alias("rep"), F.max("sid").alias("last"), F.max("n").alias("n"))
    # who holds a text: its record, or the text itself if several records hold it
    owners = checkpoint(by_text.select("*", F.when(F.col("rep") == F.col("last"), F.col("rep")).otherwise(F.col("tid")).alias("owner")))
    prints = checkpoint(rows.mapInPandas(_prints(length), "fp long, tid long").join(owners.select("tid", "owner"), "tid"))
    common = (
        prints.groupBy("fp").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("fp")
    )
    wanted = (
        prints.join(common, "fp", "left_semi")
        .groupBy("tid", "owner")
        .agg(F.collect_set("fp").alias("fps"))
        .join(owners.select("tid", F.col("rep").alias("sid")), "tid")
    )
    windows = checkpoint(
        rows.select("sid", "tid", "text")
        .join(wanted, ["sid", "tid"])
        .select("tid", "owner", "text", "fps")
        .mapInPandas(_windows(length), "h1 long, h2 long, tid long, owner long, start int")
    )
    twice = windows.groupBy("h1", "h2").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b")
    hits = windows.join(twice.select("h1", "h2"), ["h1", "h2"], "left_semi").select("tid", "start").distinct()
    merged = hits.groupBy("tid").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    spans = merged.mapInPandas(_merge(length), "tid long, span_start int, span_end int")
    whole = owners.where("rep <> last").select("tid", F.lit(0).alias("span_start"), F.col("n").alias("span_end"))
    spans = spans.join(whole.select("tid"), "tid", "left_anti").unionByName(whole)
    return heads.join(spans, "tid").select(*keys, "span_start", "span_end").distinct()


def _merge(length: int):
    """Sorted starts of shared windows to maximal intervals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tid, starts in zip(b.tid, b.starts):
                s = np.asarray(starts, dtype=np.int64)
                cut = np.flatnonzero(np.diff(s) > length)
                lo, hi = s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length
                yield pd.DataFrame({"tid": tid, "span_start": lo.astype(np.int32), "span_end": hi.astype(np.int32)})

    return run


def shared_by_page(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """``book_id, stream, page, n_chars, n_shared, anchors_hit, score`` of each placed page: how many
    of its characters lie in shared spans. Pages without places or with an empty range have 0;
    repeated rows count once. Pages meet the spans of their own stream, cell by cell, so that a long stream is no one task."""
    pages = matches.select("book_id", F.col("stream").cast("int").alias("stream"), "page", "start_pos", "end_pos", "anchors_hit", "score").distinct()
    met = overlap_join(spans, pages.select("book_id", "stream", "page", "start_pos", "end_pos"), ["book_id", "stream"], ("span_start", "span_end"), ("start_pos", "end_pos"))
    inside = met.groupBy("book_id", "stream", "page", "start_pos", "end_pos").agg(
        F.sum(F.least("end_pos", "span_end") - F.greatest("start_pos", "span_start")).cast("int").alias("_n")
    )
    return pages.join(inside, ["book_id", "stream", "page", "start_pos", "end_pos"], "left").select(
        "book_id", "stream", "page",
        F.greatest(F.lit(0), F.coalesce(F.col("end_pos") - F.col("start_pos"), F.lit(0))).alias("n_chars"),
        F.coalesce("_n", F.lit(0)).alias("n_shared"),
        "anchors_hit", "score",
    )


def shared_by_stream(spans: DataFrame, records: DataFrame) -> DataFrame:
    """``book_id, stream, n_chars, n_shared`` of each record ``book_id, stream, norm_text``: the characters
    of its text and how many of them lie in shared spans, on a page or not. Records that share nothing have
    0, null texts 0 of 0; repeated rows count once, and two texts under the same keys count together."""
    keys = ["book_id", F.col("stream").cast("int").alias("stream")]
    n = F.coalesce(F.length("norm_text"), F.lit(0)).cast("long")
    texts = records.select(*keys, F.xxhash64("norm_text").alias("_h"), n.alias("n_chars")).distinct()
    none = F.lit(0).cast("long")
    return (
        texts.select("book_id", "stream", "n_chars", none.alias("n_shared"))
        .unionByName(spans.select(*keys, none.alias("n_chars"), (F.col("span_end") - F.col("span_start")).cast("long").alias("n_shared")))
        .groupBy("book_id", "stream")
        .agg(F.sum("n_chars").alias("n_chars"), F.sum("n_shared").alias("n_shared"))
    )
