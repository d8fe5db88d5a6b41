"""Documents in containers of a fixed number of tokens, with little space unused.

A grouping genetic algorithm: a solution is a list of containers, crossover injects whole well-filled
containers of one solution into another, removes the containers that hold the same documents and
best-fits what that displaced. Documents are dealt into blocks by hash; each block evolves on
several islands, whose best solutions migrate to the next island between epochs, until a solution has no more
containers than ``least_bins`` proves necessary. What lies in poorly filled containers of the blocks is packed
again across blocks, level by level, while that can save a container; a level has as many blocks as
what is left fills, so no group grows with the table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.token_counts import counter
from quire.session import checkpoint

#: Documents in a block; islands, epochs, generations and solutions of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, SOLUTIONS = 3000, 4, 3, 12, 6
#: Containers filled less than this are opened again at the next level; share of the containers or of the
#: documents left that a level must save for another one.
FULL, GAIN = 0.985, 0.001

Bins = list[list[int]]


def best_fit(items: list[int], size: list[int], room: int, bins: Bins, loads: list[int]) -> None:
    """Put items, largest first, where least space stays; into new containers if none has room."""
    free = sorted((room - x, i) for i, x in enumerate(loads) if x < room)
    for it in sorted(items, key=size.__getitem__, reverse=True):
        s = size[it]
        at = bisect_left(free, (s, -1))
        if at == len(free):
            bins.append([it])
            loads.append(s)
            if s < room:
                insort(free, (room - s, len(bins) - 1))
        else:
            left, i = free.pop(at)
            bins[i].append(it)
            loads[i] += s
            if left > s:
                insort(free, (left - s, i))


def least_bins(size: list[int], room: int) -> int:
    """Containers that are needed at least: what does not share a container with anything from ``k`` tokens on, what
    shares none with each other, and the rest beyond the room those leave, for the ``k`` that proves most."""
    x = np.sort(np.asarray(size, dtype=np.int64))
    if not len(x) or not x[-1]:
        return min(1, len(x))
    sums = np.r_[0, np.cumsum(x)]
    half = np.searchsorted(x, room // 2, side="right")  # from here on more than half
    k = np.unique(np.r_[0, x[:half]])
    low, high = np.searchsorted(x, k), np.maximum(np.searchsorted(x, room - k, side="right"), half)
    alone, large = len(x) - high, high - half
    left = large * room - (sums[high] - sums[half])
    return int((alone + large + np.maximum(0, -(-(sums[half] - sums[low] - left) // room))).max())


def fitness(loads: list[int], room: int) -> float:
    """Mean square of how full containers are: few full ones and one nearly empty beat many half full."""
    return sum((x / room) ** 2 for x in loads) / max(1, len(loads))


def _solution(order: list[int], size: list[int], room: int, rng: Random, noise: float) -> tuple[Bins, list[int]]:
    bins: Bins = []
    loads: list[int] = []
    if noise:  # best fit of sizes with a little noise gives another good start
        noisy = sorted(order, key=lambda i: size[i] * (1 + noise * rng.random()), reverse=True)
        cut = int(len(noisy) * (1 - noise))
        best_fit(noisy[:cut], size, room, bins, loads)
        best_fit(noisy[cut:], size, room, bins, loads)
    else:
        best_fit(order, size, room, bins, loads)
    return bins, loads


def swap_in(displaced: list[int], size: list[int], room: int, bins: Bins, loads: list[int], rng: Random) -> list[int]:
    """Fill containers better by swaps with what was displaced: one document of a container against one or two
    larger together that fit. Smaller documents take their place among the displaced, and are easier to
    place. The bins are changed in place; what is displaced now is returned."""
    pool = sorted((size[i], i) for i in displaced)
    order = [i for i, x in enumerate(loads) if x < room]
    rng.shuffle(order)
    for b in order:
        better = True
        while better and loads[b] < room and pool:
            better, best = False, (0, -1, ())
            space = room - loads[b]
            for at, it in enumerate(bins[b]):
                s = size[it]
                k = bisect_left(pool, (s + space + 1, -1)) - 1  # the largest that fits
                if k >= 0 and pool[k][0] - s > best[0]:
                    best = (pool[k][0] - s, at, (k,))
                lo, hi = 0, k
                while lo < hi and best[0] < space:  # the largest pair that fits
                    two = pool[lo][0] + pool[hi][0]
                    if two > s + space:
                        hi -= 1
                    else:
                        if two - s > best[0]:
                            best = (two - s, at, (lo, hi))
                        lo += 1
                if best[0] == space:
                    break
            if best[0] > 0:
                gain, at, came = best
                out = bins[b][at]
                bins[b] = [*bins[b][:at], *bins[b][at + 1 :], *(pool[k][1] for k in came)]
                for k in reversed(came):
                    pool.pop(k)
                insort(pool, (size[out], out))
                loads[b] += gain
                better = True
    return [i for _, i in pool]


def crossover(a: tuple[Bins, list[int]], b: tuple[Bins, list[int]], size: list[int], room: int, rng: Random):
    """A child of ``a`` with whole well-filled containers of ``b``."""
    full = [i for i, x in enumerate(b[1]) if x >= 0.999 * room] or sorted(range(len(b[1])), key=lambda i: -b[1][i])[: len(b[1]) // 3 + 1]
    rng.shuffle(full)
    take = full[: max(1, len(b[1]) // 8)]
    inside = {it for i in take for it in b[0][i]}
    bins, loads, displaced = [b[0][i] for i in take], [b[1][i] for i in take], []
    low = sorted(range(len(a[1])), key=lambda i: a[1][i])[: max(1, len(a[1]) // 20)]
    low += [i for i in rng.sample(range(len(a[1])), min(3, len(a[1]))) if i not in low]
    opened = {i for i in low if a[1][i] < room}
    for i, (bin_, load) in enumerate(zip(*a)):
        if i in opened or not inside.isdisjoint(bin_):
            displaced += [it for it in bin_ if it not in inside]
        else:
            bins.append(bin_)
            loads.append(load)
    bins = [list(x) if loads[i] < room else x for i, x in enumerate(bins)]
    best_fit(swap_in(displaced, size, room, bins, loads, rng), size, room, bins, loads)
    return bins, loads


def evolve(size: list[int], room: int, seed: int, elites: list[Bins], generations: int = GENERATIONS) -> Bins:
    """The best solution of one island after some generations, starting from elites and own starts."""
    rng = Random(seed)
    order = list(range(len(size)))
    people = [(e, [sum(size[i] for i in x) for x in e]) for e in elites]
    while len(people) < SOLUTIONS:
        people.append(_solution(order, size, room, rng, 0.0 if not people else 0.08 + 0.1 * rng.random()))
    lower = least_bins(size, room)
    people.sort(key=lambda p: -fitness(p[1], room))
    for _ in range(generations):
        if len(people[0][1]) <= lower:
            break
        child = crossover(people[rng.randrange(2)], people[rng.randrange(len(people))], size, room, rng)
        people.append(child)
        people.append(crossover(people[0], child, size, room, rng))
        people.sort(key=lambda p: -fitness(p[1], room))
        del people[SOLUTIONS:]
    return people[0][0]


_ITEM = "spec_id int, room int, block long, island int, doc_id long, piece int, tokens int, bin int"
_COLUMNS = ["spec_id", "room", "block", "island", "doc_id", "piece", "tokens", "bin"]


def _rows(g: pd.DataFrame, bins: Bins) -> pd.DataFrame:
    place = [0] * len(g)
    for n, b in enumerate(bins):
        for i in b:
            place[i] = n
    return g.assign(bin=place)[_COLUMNS]


def _epoch(n: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece", "came"], ignore_index=True)
        room, seed = int(g.room[0]), hash((int(g.spec_id[0]), int(g.block[0]), int(g.island[0]), n))
        own = g[g.came == g.island[0]].reset_index(drop=True)
        elites: list[Bins] = []
        if n or g.came.nunique() == 1:
            for _, e in g.groupby("came"):
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(e.bin):
                    bins.setdefault(b, []).append(i)
                elites.append(list(bins.values()))
        return _rows(own, evolve(own.tokens.tolist(), room, seed, elites))

    return run


def _best(g: pd.DataFrame) -> pd.DataFrame:
    """The island whose solution is best."""
    loads = g.groupby(["island", "bin"]).tokens.sum()
    score = ((loads / g.room.iloc[0]) ** 2).groupby("island").mean()
    count = loads.groupby("island").size()
    best = min(score.index, key=lambda i: (count[i], -score[i], i))
    return g[g.island == best]


def _start(g: pd.DataFrame) -> pd.DataFrame:
    """A block's first island. ``island`` -1 says that no solution can use fewer containers."""
    g = g.sort_values(["doc_id", "piece"], ignore_index=True)
    room, size = int(g.room[0]), g.tokens.tolist()
    bins = evolve(size, room, hash((int(g.spec_id[0]), int(g.block[0]))), [])
    return _rows(g.assign(island=-1 if len(bins) <= least_bins(size, room) else 0), bins)


def pack_blocks(items: DataFrame) -> DataFrame:
    """Items (``spec_id, room, block, doc_id, piece, tokens``) with the ``bin`` of their block.

    Blocks whose first island reaches the least possible number of containers are done; the others
    go on with all islands and migration.
    """
    first = checkpoint(items.groupBy("spec_id", "block").applyInPandas(_start, _ITEM))
    solved = first.where("island = -1")
    state = first.where("island = 0").select(
        *(c for c in _COLUMNS if c != "island"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island")
    )
    state = state.withColumn("came", F.col("island"))
    for n in range(EPOCHS):
        if n:  # the best solution of each island stays and goes to the next one
            state = state.select(
                *(c for c in _COLUMNS if c != "island"),
                F.col("island").alias("came"),
                F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"),
            ).distinct()
        state = state.groupBy("spec_id", "block", "island").applyInPandas(_epoch(n), _ITEM)
    return solved.unionByName(state.groupBy("spec_id", "block").applyInPandas(_best, _ITEM))


def document_sizes(documents: DataFrame, names: list[str], folder: str | None = None) -> DataFrame:
    """``doc_id`` and the array ``sizes`` of numbers of tokens, in the order of ``names``; null texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tuple(names), folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "sizes": list(count(b.text.tolist()))})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, sizes array<long>")


def pack_documents(documents: DataFrame, specs: DataFrame, folder: str | None = None) -> DataFrame:
    """``spec_id, doc_id, piece, tokens, container`` for each row of ``specs`` (few: a table of settings).

    A document longer than the capacity is cut: all pieces but the last fill a container each; no other
    document is divided. Null and empty texts have 0 tokens and lie in a container like others. Rows without an id are left out, rows with
    one id count as one document; specs without capacity are left out.
    """
    rows = [r for r in specs.select("spec_id", "tokenizer", "capacity").distinct().collect() if r.capacity and r.capacity > 0]
    if not rows:
        return documents.sparkSession.createDataFrame([], "spec_id int, doc_id long, piece int, tokens int, container string")
    names = sorted({r.tokenizer for r in rows})
    sizes = checkpoint(document_sizes(documents.where("doc_id IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"]), names, folder))
    spec = F.explode(
        F.array(*(F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity).cast("int").alias("room"), F.col("sizes")[names.index(r.tokenizer)].alias("total")) for r in rows))
    ).alias("_s")
    per = sizes.select("doc_id", spec).select("doc_id", "_s.*")
    whole = F.when(F.col("total") > F.col("room"), F.floor((F.col("total") - 1) / F.col("room"))).otherwise(0).cast("int")
    per = per.withColumn("cut", whole)
    full = per.where("cut > 0").select(
        "spec_id", "doc_id", F.explode(F.expr("sequence(0, cut - 1)")).alias("piece"), F.col("room").alias("tokens")
    )
    full = full.withColumn("container", F.format_string("f%d-%d", "doc_id", "piece"))
    left = per.select(
        "spec_id", "room", "doc_id", F.col("cut").alias("piece"), (F.col("total") - F.col("cut") * F.col("room")).cast("int").alias("tokens")
    )
    columns = ["spec_id", "doc_id", "piece", "tokens", "container"]
    out, level = full.select(*columns), 0
    n_left = {int(r.spec_id): sizes.count() for r in rows}
    n_blocks = {i: max(1, -(-n // BLOCK)) for i, n in n_left.items()}
    while n_blocks:
        salt = F.xxhash64("doc_id", F.lit(level))
        block = F.pmod(salt, F.element_at(F.create_map(*(F.lit(x) for kv in n_blocks.items() for x in kv)), F.col("spec_id")))
        packed = checkpoint(pack_blocks(left.withColumn("block", block.cast("long"))))
        named = packed.withColumn("container", F.format_string(f"l{level}-%d-%d", "block", "bin"))
        loads = named.groupBy("spec_id", "container").agg(
            F.sum("tokens").alias("load"), F.max("room").alias("_r"), F.count("*").alias("_n"), F.sum((2 * F.col("tokens") > F.col("room")).cast("int")).alias("_half")
        )
        low = loads.where(F.col("load") < FULL * F.col("_r"))
        state = loads.groupBy("spec_id").agg(
            F.max("_r").alias("room"), F.count("*").alias("bins"),
            *(F.sum(F.when(F.col("load") < FULL * F.col("_r"), c).otherwise(0)).alias(n) for c, n in ((F.lit(1), "low"), (F.col("load"), "load"), (F.col("_n"), "items"), (F.col("_half"), "half"))),
        ).collect()
        again = {}
        for r in state:  # a row for each setting
            can_save = r.low > max(-(-r.load // r.room), r.half)
            shrinks = r["items"] <= (1 - GAIN) * n_left[r.spec_id] or level == 0
            if n_blocks[r.spec_id] > 1 and can_save and shrinks:
                again[r.spec_id], n_left[r.spec_id] = max(1, -(-r["items"] // BLOCK)), r["items"]
        n_blocks = again
        opened = low.where(F.col("spec_id").isin(list(again))).select("spec_id", "container")
        out = out.unionByName(named.join(opened, ["spec_id", "container"], "left_anti").select(*columns))
        left = named.join(opened, ["spec_id", "container"], "left_semi").select("spec_id", "room", "doc_id", "piece", "tokens")
        level += 1
    return out


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, n_docs, n_over, n_divided, tight`` of ``pack_documents``: documents, containers above the capacity,
    documents divided that fit in one, and whether there are at most 0.1 % and one container more than
    all tokens need. A row for each spec that has a document."""
    room = specs.groupBy("spec_id").agg(F.max("capacity").cast("int").alias("room"))
    loads = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("load")).join(F.broadcast(room), "spec_id")
    bins = loads.groupBy("spec_id").agg(
        F.sum((F.col("load") > F.col("room")).cast("int")).alias("n_over"),
        (F.count("*") <= F.lit(1.001) * F.ceil(F.sum("load") / F.max("room")) + 1).alias("tight"),
    )
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).join(F.broadcast(room), "spec_id")
    docs = docs.groupBy("spec_id").agg(F.count("*").alias("n_docs"), F.sum(((F.col("n") > 1) & (F.col("t") <= F.col("room"))).cast("int")).alias("n_divided"))
    return docs.join(bins, "spec_id").select("spec_id", "n_docs", "n_over", "n_divided", "tight")
