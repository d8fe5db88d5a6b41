"""The book's own text of web pages, apart from the furniture of the site around it.

Union-free wrappers are inferred from the pages of one host. A page is a stream of lines and a line a
stream of tokens (numbers and the host's name masked). Lines of a host that begin or end alike are
aligned one after the other: tokens and neighbourhoods all of them hold stay, what does not match becomes
a text slot. That alignment is an intersection, so it comes out the same in whatever order, batch or file
lines are met, and partial results combine before they move. Pages are then streams of line wrappers and
of slots, aligned in turn: a wrapper some pages lack is an optional group, neighbouring slots of one
kind fold into a repeated group, and lines of one markup into a group of that markup. A line wrapper is furniture if it
keeps constants that are no words of the book, its lines have about one length and stand outside the
stretch from a page's first paragraph to its last; a repeated group of slots if it recurs over pages
and books of its host in such places; a group of a markup if other wrappers cover what stands in it.
Lines as long as paragraphs are judged first, by their recurrence alone: they say where a page's text lies.

What a host's pages need to know is a list per host, which meets the pages in a broadcast while it is
small and in a join salted by the host's pages beyond that (``meet``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.spam_shapes import plain
from quire.session import checkpoint

SLOT = "*"
#: Tokens from which a line looks like a paragraph.
PARAGRAPH = 13
#: Lines and books of its host a wrapper needs.
LINES, BOOKS = 4, 2
#: Hosts that must have inferred a wrapper for it to serve all others that have such lines.
HOSTS = 3
#: Tokens at either end by which long lines are compared; share of such a line that must be constant; books
#: from which on a long line need not recur within each (before that it may be the text of some editions).
ENDS, CONSTANT, MANY_BOOKS = 6, 0.75, 8
#: Share of a wrapper's lines that stand outside the paragraphs; how much lengths may vary.
OUTSIDE, SPREAD = 0.75, 2.0
#: A constant is no word of the book if it is so much rarer in paragraphs than in other lines.
FOREIGN = 0.1
#: Lines of one markup on a host are a group if there are so many and wrappers cover this share of them.
MARKED, MARKUP = 20, 0.97
#: Bytes of the hosts' lists up to which they are broadcast; pages of a host that share a salt beyond.
SMALL, SALTED = 32 << 20, 20_000

_TAG = re.compile(r"<!--.*?-->|<[^>\n]*>")
_NAME = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)(?:[^>]*?class=\"([^\"]*)\")?[^>]*>")
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "b", "strong"}
_DIGITS = re.compile(r"\d+")
_COUNTER = "(#)"


def _masked(text: str, host: str | None) -> str:
    out = _TAG.sub(" ", text) if "<" in text else text
    out = plain(html.unescape(out) if "&" in out else out)
    return _DIGITS.sub("#", out.replace(host, "@") if host else out)


def line_tokens(line: str, host: str | None) -> list[str]:
    """Tokens of a line without markup: plain characters, numbers as ``#``, the host's name as ``@``."""
    return _masked(line, host).split()


def text_streams(text: str, host: str | None) -> list[list[str]]:
    """The token streams of the lines of a text (split at line feeds)."""
    raw, lines = text.count("\n") + 1, _masked(text, host).split("\n")
    if len(lines) != raw:  # an entity was a line feed
        return [line_tokens(x, host) for x in text.split("\n")]
    return [x.split() for x in lines]


def markup(line: str) -> str:
    """The markup of a line: tag names with their classes, from outside in; empty for plain text."""
    if "<" not in line:
        return ""
    return ">".join(a.lower() + ("." + c if c else "") for a, c in _NAME.findall(line) if a.lower() != "br")


def is_heading(mark: str) -> bool:
    return any(p.split(".")[0] in _HEADING for p in mark.split(">"))


def digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def block_keys(tokens: list[str]) -> list[str]:
    """Keys of the alignment blocks of a short line: the whole of the shortest, its first three, two, one, its
    last two, one."""
    n = len(tokens)
    keys = ["=" + " ".join(tokens)] if n <= 3 else []
    keys += ["^" + " ".join(tokens[:k]) for k in (3, 2, 1) if n > k]
    return keys + ["$" + " ".join(tokens[-k:]) for k in (2, 1) if n > k]


def long_keys(field: str, tokens: list[str]) -> list[int]:
    """Digests of a long line: of the whole, of how it begins and how it ends."""
    return [digest(field, a, *t) for a, t in (("=", tokens), ("^", tokens[:ENDS]), ("$", tokens[-ENDS:]))]


def items(tokens: list[str]) -> frozenset[str]:
    """What a stream holds: its tokens, numbered if they come again, and its neighbourhoods, ends included."""
    times: dict[str, int] = {}
    out = set()
    for t in tokens:
        times[t] = k = times.get(t, 0) + 1
        out.add(f"{t}\1{k}")
    ends = ["", *tokens, ""]
    out.update(f"{a}\2{b}" for a, b in zip(ends, ends[1:]))
    return frozenset(out)


def pattern(least: list[str], common: set[str]) -> list[str]:
    """The wrapper of streams that hold ``common`` between them, in the order of the least of them."""
    out: list[str] = []
    last, times = "", {}
    for t in [*least, ""]:
        times[t] = k = times.get(t, 0) + 1
        if t and f"{t}\1{k}" not in common:
            continue
        if f"{last}\2{t}" not in common and (not out or out[-1] != SLOT):
            out.append(SLOT)
        if t:
            out.append(t)
        last = t
    return out


def align(streams: list[list[str]]) -> list[str]:
    """The most special wrapper of streams: common tokens, slots for what does not match."""
    return pattern(min(streams), set.intersection(*(set(items(s)) for s in streams)))


def covers(wrapper: list[str], tokens: list[str]) -> bool:
    """Whether a wrapper matches a stream: slots take none or more tokens."""
    i = j = 0
    slot = mark = -1
    while j < len(tokens):
        if i < len(wrapper) and wrapper[i] == SLOT:
            slot, mark = i, j
            i += 1
        elif i < len(wrapper) and wrapper[i] == tokens[j]:
            i, j = i + 1, j + 1
        elif slot >= 0:
            mark += 1
            i, j = slot + 1, mark
        else:
            return False
    return all(t == SLOT for t in wrapper[i:])


def pages_by_field(pages: DataFrame) -> DataFrame:
    """``page_id, host, book_id, title, field, text``: a row per text field of each page, repeated rows once.
    Pages without a host are the pages of one host without a name."""
    once = pages.where("page_id IS NOT NULL").select("page_id", F.coalesce("host", F.lit("")).alias("host"), "book_id", "title", "body", "footnotes")
    return once.dropDuplicates(["page_id"]).select(
        "page_id", "host", "book_id", "title",
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("body", "footnotes")))).alias("_t"),
    ).select("page_id", "host", "book_id", "title", "_t.field", "_t.text").where("text IS NOT NULL")


_PARSED = (
    "page_id long, host string, book long, field string, untitled boolean, nos array<int>, marks array<string>, streams array<string>,"
    " title_nos array<int>, long_nos array<int>, long_sizes array<int>, long_keys array<long>"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for page, host, book, field, title, text in zip(b.page_id, b.host, b.book_id, b.field, b.title, b.text):
            own_title = line_tokens(title, host) if title else None
            nos, marks, streams, titles, at, sizes, keys = [], [], [], [], [], [], []
            raw = text.split("\n") if "<" in text else None
            for n, tokens in enumerate(text_streams(text, host)):
                if not tokens:
                    continue
                if own_title == tokens:
                    titles.append(n)
                if len(tokens) >= PARAGRAPH:
                    at.append(n)
                    sizes.append(len(tokens))
                    keys += long_keys(field, tokens)
                else:
                    nos.append(n)
                    marks.append(markup(raw[n]) if raw else "")
                    streams.append(" ".join(tokens))
            if nos or at:
                rows.append((page, host, digest(book or ""), field, title is None, nos, marks, streams, titles, at, sizes, keys))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


def parse_pages(fields: DataFrame) -> DataFrame:
    """The lines of each text: token streams of short lines, digests of long ones. Lines without text are left out."""
    return checkpoint(fields.mapInPandas(_parse, _PARSED))


def meet(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with what ``lists`` (a row per host: ``host, packed``) holds for their host; null if it has none."""
    lists = checkpoint(lists)
    size = lists.agg(F.sum(F.octet_length("packed") + F.octet_length("host"))).first()[0] or 0
    if size <= SMALL:
        return rows.join(F.broadcast(lists), "host", "left")
    salts = rows.groupBy("host").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("_n"))
    many = lists.join(salts, "host").select("host", "packed", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"), "_n")
    salted = rows.join(F.broadcast(salts), "host") if salts.count() <= SALTED else rows.join(salts, "host")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.col("_n")).cast("int"))
    return salted.join(many.drop("_n"), ["host", "_salt"], "left").drop("_salt", "_n")


def _pack(df: DataFrame, *columns: str) -> DataFrame:
    """A host's rows as one string: rows by line feeds, columns by vertical tabs."""
    line = F.concat_ws("\x0b", *(F.col(c).cast("string") for c in columns))
    return df.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("packed"))


class _Lists:
    """Unpacked lists of the hosts of one task."""

    def __init__(self, read):
        self.read, self.known = read, {}

    def __call__(self, host: str, packed: str | None):
        if host not in self.known:
            self.known[host] = self.read([x.split("\x0b") for x in packed.split("\n")] if packed else [])
        return self.known[host]


# Long lines


def _long_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n: dict = {}
        for host, book, nos, titles, keys in zip(b.host, b.book, b.long_nos, b.title_nos, b.long_keys):
            own = set(titles)
            for k in {k for i, no in enumerate(nos) if no not in own for k in keys[3 * i : 3 * i + 3].tolist()}:
                n[host, k, book] = n.get((host, k, book), 0) + 1
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["host", "key", "book", "n"])


def _long_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each recurring beginning or end, aligned within a batch."""
    known = _Lists(lambda rows: {int(r[0]) for r in rows})
    for b in batches:
        blocks = _Blocks()
        for host, field, text, packed in zip(b.host, b.field, b.text, b.packed):
            wanted = known(host, packed)
            for tokens in text_streams(text, host) if wanted else ():
                if len(tokens) >= PARAGRAPH:
                    for k in long_keys(field, tokens):
                        if k in wanted:
                            blocks.add(host, k, " ".join(tokens))
        yield blocks.frame()


def long_notices(fields: DataFrame, parsed: DataFrame) -> DataFrame:
    """``host, key, constant``: digests of lines of ``PARAGRAPH`` tokens or more that are furniture on their host,
    and how many constant tokens their block has.

    Such a line recurs on its host as a whole, or begins or ends as others do and is constant for the
    most part, on as many pages and in as many books as a wrapper of the host needs. What stands
    once in each of a few books is no furniture: they may be editions of one text.
    """
    seen = parsed.where(F.size("long_nos") > 0).mapInPandas(_long_stats, "host string, key long, book long, n long")
    recurring = (
        seen.groupBy("host", "key", "book").agg(F.sum("n").alias("n"))
        .groupBy("host", "key").agg(F.sum("n").alias("n"), F.count("*").alias("books"))
        .where((F.col("n") >= LINES) & (F.col("books") >= BOOKS))
        .where((F.col("n") >= 2 * F.col("books")) | (F.col("books") >= MANY_BOOKS))
    )
    recurring = checkpoint(recurring.select("host", "key"))
    if recurring.isEmpty():
        return recurring.withColumn("constant", F.lit(0))
    lines = meet(fields.join(F.broadcast(recurring.select("host").distinct()), "host", "left_semi"), _pack(recurring, "key"))
    blocks = _aligned(lines.mapInPandas(_long_blocks, _BLOCK))
    return blocks.select("host", "key", F.size(F.filter("wrapper", lambda t: t != SLOT)).alias("constant"))


# Blocks of lines that begin or end alike, and their wrappers

_BLOCK = "host string, key long, item long, n long, least string"


class _Blocks:
    """Streams of blocks, aligned as they come: what all of a block's streams hold so far."""

    def __init__(self):
        self.state: dict = {}
        self.items: dict[str, frozenset[str]] = {}

    def add(self, host: str, key: int, stream: str) -> None:
        held = self.items.get(stream)
        if held is None:
            held = self.items[stream] = items(stream.split(" "))
        s = self.state.get((host, key))
        if s is None:
            self.state[host, key] = [1, held, stream]
            return
        s[0] += 1
        if s[1] is not held:
            s[1] = s[1] & held
            s[2] = min(s[2], stream)

    def frame(self) -> pd.DataFrame:
        """Rows of each block: its least stream (item 0), and digests of what all its streams hold."""
        digests = {i: digest(i) for _, held, _ in self.state.values() for i in held}
        rows = []
        for (host, key), (n, held, least) in self.state.items():
            rows.append((host, key, 0, n, least))
            rows += [(host, key, digests[i], n, None) for i in held]
        return pd.DataFrame(rows, columns=["host", "key", "item", "n", "least"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _wrapper(least: pd.Series, held: pd.Series) -> pd.Series:
    out = []
    for a, c in zip(least, held):
        tokens, c = a.split(" "), set(c.tolist())
        out.append(pattern(tokens, {i for i in items(tokens) if digest(i) in c}))
    return pd.Series(out, dtype=object)


def _aligned(blocks: DataFrame) -> DataFrame:
    """``host, key, wrapper`` of blocks aligned in part: what every part holds stays."""
    merged = blocks.groupBy("host", "key", "item", "least").agg(F.sum("n").alias("n"))  # numbers alone: hashed, not sorted
    whole = merged.groupBy("host", "key").agg(F.collect_list(F.struct("item", "n", "least")).alias("_i"))
    heads = F.filter("_i", lambda x: x["item"] == 0)
    whole = whole.select(
        "host", "key", "_i", F.aggregate(heads, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"), F.array_min(F.transform(heads, lambda x: x["least"])).alias("least")
    )
    held = F.transform(F.filter("_i", lambda x: (x["n"] == F.col("n")) & (x["item"] != 0)), lambda x: x["item"])
    return whole.select("host", "key", _wrapper("least", held).alias("wrapper"))


def _places(nos: list[int], paragraphs: list[int]) -> list[int]:
    """Place of each line: -1 before the first paragraph, 1 after the last, 0 between, 2 where there is none."""
    if not paragraphs:
        return [2] * len(nos)
    lo, hi = min(paragraphs), max(paragraphs)
    return [-1 if n < lo else 1 if n > hi else 0 for n in nos]


def _read_notices(rows: list[list[str]]) -> dict[int, int]:
    return {int(k): int(c) for k, c in rows}


def _notice_nos(nos, sizes, keys, titles, known: dict[int, int]) -> set[int]:
    """Line numbers of a page's long lines that are furniture."""
    if not known:
        return set()
    own = set(titles)
    return {
        int(no)
        for i, (no, size) in enumerate(zip(nos, sizes))
        if no not in own and any(k in known and known[k] >= CONSTANT * size for k in keys[3 * i : 3 * i + 3].tolist())
    }


_STATS = "host string, key long, field string, kind string, n long, low long, high long, n_placed long, n_out long, len_sum long, len_sq long, n_title long"


def _short_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of each block of short lines, nothing else: most blocks go no further."""
    known = _Lists(_read_notices)
    keyed: dict[str, list[str]] = {}
    for b in batches:
        out: dict = {}
        for host, book, field, nos, streams, titles, at, sizes, keys, packed in zip(
            b.host, b.book, b.field, b.nos, b.streams, b.title_nos, b.long_nos, b.long_sizes, b.long_keys, b.packed
        ):
            notices = _notice_nos(at, sizes, keys, titles, known(host, packed))
            paragraphs = [n for n in at.tolist() if n not in notices]
            titles = set(titles.tolist())
            for no, s, p in zip(nos.tolist(), streams, _places(nos.tolist(), paragraphs)):
                found = keyed.get(s)
                if found is None:
                    if len(keyed) > 200_000:
                        keyed.clear()
                    found = keyed[s] = block_keys(s.split(" "))
                size = s.count(" ") + 1
                for k in found:
                    o = out.get((host, field, k))
                    if o is None:
                        o = out[host, field, k] = [0, book, book, 0, 0, 0, 0, 0]
                    o[0] += 1
                    if book < o[1]:
                        o[1] = book
                    elif book > o[2]:
                        o[2] = book
                    o[3] += p != 2
                    o[4] += p in (-1, 1)
                    o[5] += size
                    o[6] += size * size
                    o[7] += no in titles
        yield pd.DataFrame([(h, digest(f, k), f, k[0] + (k[1:] if k == "$" + _COUNTER else ""), *v) for (h, f, k), v in out.items()], columns=[c.split()[0] for c in _STATS.split(", ")])


def _short_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Lists(lambda rows: {int(r[0]) for r in rows})
    keyed: dict[tuple[str, str], list[int]] = {}
    for b in batches:
        blocks = _Blocks()
        for host, field, streams, packed in zip(b.host, b.field, b.streams, b.packed):
            wanted = known(host, packed)
            if not wanted:
                continue
            for s in streams:
                found = keyed.get((field, s))
                if found is None:
                    if len(keyed) > 200_000:
                        keyed.clear()
                    found = keyed[field, s] = [digest(field, k) for k in block_keys(s.split(" "))]
                for k in found:
                    if k in wanted:
                        blocks.add(host, k, s)
        yield blocks.frame()


def _word_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each token stands in paragraphs, and in shorter lines."""
    for b in batches:
        long: dict[str, int] = {}
        short: dict[str, int] = {}
        for host, text in zip(b.host, b.text):
            for tokens in text_streams(text, host):
                n = long if len(tokens) >= PARAGRAPH else short
                for t in set(tokens):
                    n[t] = n.get(t, 0) + 1
        yield pd.DataFrame([(t, long.get(t, 0), short.get(t, 0)) for t in {**long, **short}], columns=["token", "n_long", "n_short"])


def line_wrappers(fields: DataFrame, parsed: DataFrame, notices: DataFrame) -> DataFrame:
    """Wrappers of short furniture: ``host, field, key, wrapper, n``. Blocks below the support, or that stand among
    the paragraphs of all hosts, are dropped before they are aligned; nothing else is."""
    seen = meet(parsed.where(F.size("nos") > 0), _pack(notices, "key", "constant")).mapInPandas(_short_stats, _STATS)
    sums = [F.sum(c).alias(c) for c in ("n", "n_placed", "n_out", "len_sum", "len_sq", "n_title")]
    own = checkpoint(seen.groupBy("host", "field", "key", "kind").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")))
    inside = (
        own.groupBy("field", "key").agg(F.sum("n_placed").alias("n_placed"), F.sum("n_out").alias("n_out"))
        .where((F.col("n_placed") >= 6) & (F.col("n_out") < OUTSIDE * F.col("n_placed"))).select("field", "key")
    )
    mean = F.col("len_sum") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("len_sq") / F.col("n") - mean * mean))
    shaped = own.where((F.col("n") >= LINES) & (F.col("low") != F.col("high")) & (spread <= SPREAD) & (F.col("n_title") <= 0.2 * F.col("n"))).where(
        (F.col("field") == "footnotes") | ((F.col("n_placed") >= 3) & (F.col("n_out") >= OUTSIDE * F.col("n_placed")))
    )
    shaped = checkpoint(shaped.join(inside, ["field", "key"], "left_anti").select("host", "field", "key", "kind", "n"))
    blocks = _aligned(meet(parsed, _pack(shaped, "key")).mapInPandas(_short_blocks, _BLOCK))
    wrappers = checkpoint(shaped.join(blocks, ["host", "key"]))
    words = fields.mapInPandas(_word_places, "token string, n_long long, n_short long").groupBy("token").agg(
        F.sum("n_long").alias("n_long"), F.sum("n_short").alias("n_short")
    )
    constants = F.array_distinct(F.filter("wrapper", lambda t: (t != SLOT) & t.rlike(r"[\p{L}@]")))
    foreign = (
        wrappers.select("host", "key", F.explode(constants).alias("token")).join(words, "token")
        .where(F.col("n_long") <= FOREIGN * F.col("n_short")).select("host", "key").distinct()
    )
    worded = wrappers.join(foreign, ["host", "key"], "left_semi")
    counters = wrappers.where((F.col("field") == "body") & (F.col("kind") == "$" + _COUNTER))  # a slot with a counter: no words at all
    mine = checkpoint(worded.unionByName(counters).dropDuplicates(["host", "key"]).select("host", "field", "key", "wrapper", "n"))
    # what several hosts have each inferred from their own pages serves the hosts with too few of such lines
    shared = mine.groupBy("field", "key").agg(F.count("*").alias("hosts"), F.min(F.struct(F.size("wrapper"), "wrapper")).alias("_w")).where(F.col("hosts") >= HOSTS)
    others = own.join(shared.select("field", "key", "_w.wrapper"), ["field", "key"]).join(mine, ["host", "key"], "left_anti")
    return checkpoint(mine.unionByName(others.select("host", "field", "key", "wrapper", "n")))


# Pages as streams of line wrappers and slots

#: Symbols of a page's stream: a line of a wrapper, a notice, a paragraph, the title, a heading, a slot of a few
#: words without the end of a sentence, one with a counter, either of them a line of a wrapper too, any other line.
WRAPPER, NOTICE, TEXT, TITLE, HEADING, WORDS, COUNTED, BOTH, OTHER = "wnpthscb-"
COVERED = WRAPPER + NOTICE + BOTH
_FEW = 3
_SYMBOLS = "page_id long, host string, book long, field string, untitled boolean, nos array<int>, marks array<string>, symbols string"


def _symbol(stream: str, mark: str) -> str:
    if is_heading(mark):
        return HEADING
    t = stream.split(" ")
    body = t[:-1] if t[-1] == _COUNTER else t
    if 1 <= len(body) <= _FEW and all(x[-1].isalnum() and any(map(str.isalpha, x)) for x in body):
        return WORDS if len(body) == len(t) else COUNTED
    return OTHER


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def read(rows: list[list[str]]):
        notices, wrappers = {}, {}
        for kind, key, value in rows:
            if kind == NOTICE:
                notices[int(key)] = int(value)
            else:
                wrappers[int(key)] = value.split(" ")
        return notices, wrappers, {}

    known = _Lists(read)
    for b in batches:
        rows = []
        for page, host, book, field, untitled, nos, marks, streams, titles, at, sizes, keys, packed in zip(
            b.page_id, b.host, b.book, b.field, b.untitled, b.nos, b.marks, b.streams, b.title_nos, b.long_nos, b.long_sizes, b.long_keys, b.packed
        ):
            notices, wrappers, judged = known(host, packed)
            gone = _notice_nos(at, sizes, keys, titles, notices)
            own = set(titles.tolist())
            line = [(n, "", NOTICE if n in gone else TEXT) for n in at.tolist()]
            for n, mark, s in zip(nos.tolist(), marks, streams):
                if n in own:
                    line.append((n, mark, TITLE))
                    continue
                known_line = judged.get((field, s))
                if known_line is None:
                    t = s.split(" ")
                    known_line = any((w := wrappers.get(digest(field, k))) and covers(w, t) for k in block_keys(t))
                    if len(judged) < 200_000:
                        judged[field, s] = known_line
                symbol = _symbol(s, mark)
                line.append((n, mark, symbol if not known_line else BOTH if symbol in (WORDS, COUNTED) else WRAPPER))
            line.sort()
            rows.append((page, host, book, field, untitled, [x[0] for x in line], [x[1] for x in line], "".join(x[2] for x in line)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SYMBOLS.split(", ")])


_RUN = re.compile(f"[{WORDS}{COUNTED}{BOTH}]{{2,}}")


def runs(symbols: str, field: str, untitled: bool) -> list[tuple[int, int, bool | None]]:
    """Neighbouring slots of a page's stream folded into repeated groups: from, to, and whether the group stands
    outside the paragraphs (null on pages without any). On a page without a known title the line before
    the first paragraph may be the title and is in no group."""
    if field != "body":
        return []
    lo, hi = symbols.find(TEXT), symbols.rfind(TEXT)
    own = lo - 1 if untitled and lo > 0 and symbols[lo - 1] == WORDS else -1
    if own >= 0:
        symbols = symbols[:own] + OTHER + symbols[own + 1 :]
    return [(m.start(), m.end(), None if lo < 0 else m.end() <= lo or m.start() > hi) for m in _RUN.finditer(symbols)]


def _group_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n: dict = {}
        for host, book, field, untitled, marks, symbols in zip(b.host, b.book, b.field, b.untitled, b.marks, b.symbols):
            found = [out for _, _, out in runs(symbols, field, untitled)]
            if found:
                v = n.setdefault((host, field, "run", ""), [0, book, book, 0, 0])
                v[0] += 1
                v[1], v[2] = min(v[1], book), max(v[2], book)
                v[3] += sum(x is not None for x in found)
                v[4] += sum(x is True for x in found)
            for m, s in zip(marks, symbols):
                if m and s != TEXT:
                    v = n.setdefault((host, field, "markup", m), [0, book, book, 0, 0])
                    v[0] += 1
                    v[3] += 1
                    v[4] += s in COVERED
        yield pd.DataFrame([(*k, *v) for k, v in n.items()], columns=["host", "field", "kind", "markup", "n", "low", "high", "n_placed", "n_good"])


def page_groups(symbols: DataFrame) -> DataFrame:
    """``host, field, kind, markup, n``: the repeated groups of slots (``run``) and groups of one markup that are
    furniture of their host."""
    s = symbols.mapInPandas(_group_stats, "host string, field string, kind string, markup string, n long, low long, high long, n_placed long, n_good long")
    s = s.groupBy("host", "field", "kind", "markup").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("n", "n_placed", "n_good"))
    )
    run = (F.col("kind") == "run") & (F.col("n") >= LINES) & (F.col("low") != F.col("high")) & (F.col("n_good") >= OUTSIDE * F.col("n_placed"))
    marked = (F.col("kind") == "markup") & (F.col("n") >= MARKED) & (F.col("n_good") >= MARKUP * F.col("n"))
    return s.where(run | marked).select("host", "field", "kind", "markup", "n")


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Lists(lambda rows: {tuple(r) for r in rows})
    for b in batches:
        pages, fields, lines = [], [], []
        for page, host, field, untitled, nos, marks, symbols, packed in zip(
            b.page_id, b.host, b.field, b.untitled, b.nos, b.marks, b.symbols, b.packed
        ):
            groups = known(host, packed)
            no = {i for i, s in enumerate(symbols) if s in COVERED}
            if groups:
                no |= {i for i, (m, s) in enumerate(zip(marks, symbols)) if m and s not in (TEXT, TITLE) and (field, "markup", m) in groups}
                if (field, "run", "") in groups:
                    for i, j, _ in runs(symbols, field, untitled):
                        no.update(range(i, j))
            got = nos[sorted(no)].tolist() if no else []
            pages += [page] * len(got)
            fields += [field] * len(got)
            lines += got
        yield pd.DataFrame({"page_id": np.array(pages, dtype=np.int64), "field": pd.Series(fields, dtype=object), "line_no": np.array(lines, dtype=np.int32)})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of each host as its groups: ``host, field, kind, pattern, optional, repeated, n``.

    ``kind`` is ``line`` (``pattern`` is a regular expression over tokens joined by spaces), ``run`` (neighbouring
    slots) or ``markup`` (a slot in that markup); ``n`` counts lines, of runs pages that hold them. A
    group is ``repeated`` if it takes neighbouring lines, and ``optional`` as pages may lack it.
    """
    fields, _, lines, symbols = _inferred(pages)
    n_pages = fields.groupBy("host", "field").agg(F.count("*").alias("_pages"))
    body = F.concat_ws("", F.transform("wrapper", lambda t: F.when(t == SLOT, F.lit(r"(?:\S+ )*?")).otherwise(F.concat(F.regexp_replace(t, r"([^\p{L}\p{N}#@])", r"\\$1"), F.lit(" ")))))
    out = lines.select("host", "field", F.lit("line").alias("kind"), F.concat(F.lit("^"), body, F.lit("$")).alias("pattern"), F.lit(False).alias("repeated"), "n")
    groups = page_groups(symbols)
    out = out.unionByName(groups.select("host", "field", "kind", F.col("markup").alias("pattern"), (F.col("kind") == "run").alias("repeated"), "n"))
    return out.join(n_pages, ["host", "field"]).select("host", "field", "kind", "pattern", (F.col("n") < F.col("_pages")).alias("optional"), "repeated", "n")


def _inferred(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    fields = checkpoint(pages_by_field(pages))
    parsed = parse_pages(fields)
    notices = long_notices(fields, parsed)
    lines = line_wrappers(fields, parsed, notices)
    known = notices.select("host", F.lit(NOTICE).alias("kind"), "key", F.col("constant").cast("string").alias("value")).unionByName(
        lines.select("host", F.lit(WRAPPER).alias("kind"), "key", F.array_join("wrapper", " ").alias("value"))
    )
    symbols = checkpoint(meet(parsed, _pack(known, "kind", "key", "value")).mapInPandas(_symbols, _SYMBOLS))
    return fields, notices, lines, symbols


def _furniture(symbols: DataFrame) -> DataFrame:
    groups = _pack(page_groups(symbols), "field", "kind", "markup")
    return meet(symbols, groups).mapInPandas(_found, "page_id long, field string, line_no int")


def page_furniture(pages: DataFrame) -> DataFrame:
    """``page_id, field, line_no`` of each line of ``body`` or ``footnotes`` that is furniture.

    Lines count from 0 at line feeds. Null texts and lines without text have none; repeated rows count
    once. Pages without a host are taken for one host's; a page of a host with too few pages or books for
    any wrapper has no furniture.
    """
    return _furniture(_inferred(pages)[3])


def own_text(pages: DataFrame) -> DataFrame:
    """``page_id, field, text``: each text without its furniture, markup and lines without text."""
    fields, _, _, symbols = _inferred(pages)
    drop = _furniture(symbols).groupBy("page_id", "field").agg(F.collect_set("line_no").alias("_drop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, field, text, gone in zip(b.page_id, b.field, b.text, b["_drop"]):
                gone = set(gone) if gone is not None else set()
                kept = [html.unescape(_TAG.sub(" ", x)).strip() for n, x in enumerate(text.split("\n")) if n not in gone]
                rows.append((i, field, "\n".join(x for x in kept if x)))
            yield pd.DataFrame(rows, columns=["page_id", "field", "text"])

    return fields.join(drop, ["page_id", "field"], "left").mapInPandas(run, "page_id long, field string, text string")
