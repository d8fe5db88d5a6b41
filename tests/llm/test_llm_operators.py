import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import encodings, lookalikes, packing, page_wrappers, repeated_lines, shared_spans, spam_shapes, tokenize

WORDS = {
    "ar": "كتاب بيت شجرة قلم مدرسة سماء ماء طريق جديد قديم كبير صغير يكتب يقرأ يشرب في من على إلى عن بعد قبل ثم لكن".split(),
    "fr": "été forêt mère élève château déjà où garçon près très maison jardin livre rouge petit grand dans pour avec sans".split(),
    "ru": "сад мельница глава дом река небо".split(),
}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS[lang], k=rng.randrange(5, 11))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return encodings.fit(sentences("ar", 1500, 1) + sentences("fr", 400, 2) + sentences("ru", 100, 3))


def test_garble_inverts():
    text = "forêt «بيت» 12"
    for chain in encodings.CHAINS:
        if chain[0][0] != "utf-8" or chain[-1][1] == "utf-8":
            continue
        back, strict, share = encodings.invert(encodings.garble(text, chain), chain)
        assert back == text and strict and share == 1.0, chain


def test_held_out_accuracy(model):
    clean = sentences("ar", 200, 11) + sentences("fr", 60, 12) + sentences("ru", 20, 13)
    assert sum(bool(encodings.find_stretches(x, model)) for x in clean) == 0
    right = tried = 0
    for chain in encodings.CHAINS[:7]:
        for x in sentences("ar", 40, 21):
            tried += 1
            bad = encodings.garble(x, chain)
            right += encodings.restore(bad, encodings.find_stretches(bad, model)) == x
    assert right >= 0.97 * tried
    part = "بيت كبير " + encodings.garble("شجرة قديم في", encodings.CHAINS[0]) + " على طريق"
    assert encodings.restore(part, encodings.find_stretches(part, model)) == "بيت كبير شجرة قديم في على طريق"
    lost = encodings.garble("كتاب جديد في مدرسة كبير", (("cp1256", "utf-8"),))
    found = encodings.find_stretches(lost, model)
    assert found and found[0].restored is None


def test_signs_alone_and_recall_by_chain():
    rng = random.Random(14)
    signed = [" ".join(rng.choice(("{}", "{}", "{}", "\u201c{}", "{}\u201d", "{}\u2019s", "\u2014 {}")).format(w) for w in x.split()) for x in sentences("fr", 800, 5)]
    model = encodings.fit(sentences("ar", 1500, 1) + signed + sentences("ru", 100, 3))
    for x in ("le jardin again\u2019s. dans", "en \u201cgrand rouge\u201d petit", "petit \u2014 grand"):
        for chain in encodings.CHAINS:
            if chain in ((("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))):
                bad = encodings.garble(x, chain)
                assert encodings.restore(bad, encodings.find_stretches(bad, model)) == x, (x, chain)
    clean = sentences("ar", 60, 31) + sentences("fr", 60, 32)
    assert sum(bool(encodings.find_stretches(x, model)) for x in clean + signed[:100]) == 0
    for chain in encodings.CHAINS:
        bad = [(x, g) for x in clean if (g := encodings.garble(x, chain)) != x and g.count("?") <= x.count("?")]
        found = [encodings.find_stretches(g, model) for _, g in bad]
        if len(bad) >= 20 and chain[-1][1] != "utf-8" and chain[0][0] == "utf-8":
            assert sum(map(bool, found)) >= 0.97 * len(bad), chain
            assert sum(encodings.restore(g, f) == x for (x, g), f in zip(bad, found)) >= 0.9 * len(bad), chain


def test_garbled_lines_edges(spark, model):
    bad = encodings.garble("كتاب جديد في مدرسة", encodings.CHAINS[0])
    rows = [(1, [bad, "كتاب", None, ""], "x"), (1, [bad, "كتاب", None, ""], "x"), (2, None, "x"), (3, [], "x"), (4, ["كتاب " * 5000], "x")]
    df = spark.createDataFrame(rows, "block_id long, lines array<string>, chain string")
    got = encodings.garbled_lines(df, model).collect()
    assert [(r.block_id, r.line_no, r.restored, r.recovered) for r in got] == [(1, 0, "كتاب جديد في مدرسة", True)]
    assert encodings.garbled_lines(df.limit(0), model).count() == 0
    assert encodings.train(df.limit(0)).table.shape[0] > 0


def test_every_chain_is_tried(model, monkeypatch):
    clean = "كتاب جديد في مدرسة"
    bad = encodings.garble(clean, encodings.CHAINS[0])
    n = len(encodings.CHAINS) + 1

    def scores(words, m):  # the true chain ranks eighth
        row = np.zeros(n, dtype=np.float32)
        row[[c for c in range(2, n) if encodings.CHAINS[c - 1][-1][1] == "utf-8"][:1]] = 50
        row[[c for c in range(2, n) if encodings.CHAINS[c - 1][-1][1] != "utf-8"][:6]] = 49
        row[1] = 48
        return [row for _ in words]

    monkeypatch.setattr(encodings, "_word_scores", scores)
    monkeypatch.setattr(encodings, "invert", lambda x, chain, f=encodings.invert: f(x, chain) if chain == encodings.CHAINS[0] else (x, False, 0.0))
    assert encodings.restore(bad, encodings.find_stretches(bad, model)) == clean


def test_training_sample_is_filled(spark, monkeypatch):
    got = []
    monkeypatch.setattr(encodings, "fit", got.append)
    lines = [f"lïne {i}" for i in range(400)] + ["agaïn"] * 3500 + [f"كتاب {i}" for i in range(50)] + ["plain"] * 50
    df = spark.createDataFrame([(i, lines[i * 40 : i * 40 + 40]) for i in range(100)], "block_id long, lines array<string>")
    encodings.train(df, sample=100)
    assert len(set(got[0])) == len(got[0]) == 150
    encodings.train(df, sample=5000)
    assert len(set(got[1])) == 451
    encodings.train(df, longest=6)
    assert set(got[2]) == {"agaïn"} | {f"lïne {i}" for i in range(10)} | {f"كتاب {i}" for i in range(10)}


def brute_spans(rows, n):
    seen = defaultdict(set)
    for key, t in rows:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]].add(key)
    out = set()
    for key, t in set(rows):
        cur = None
        for i in (i for i in range(len(t) - n + 1) if len(seen[t[i : i + n]]) > 1):
            if cur and i <= cur[1]:
                cur[1] = i + n
            else:
                if cur:
                    out.add((*key, *cur))
                cur = [i, i + n]
        if cur:
            out.add((*key, *cur))
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choices("ab𝔘ا", k=rng.randrange(10, 60))) for _ in range(12)]
    rows = [((f"b{i}", i % 2), "".join(rng.choices(pool, k=rng.randrange(5)) + rng.choices("xyz", k=5))) for i in range(40)]
    rows += [(("c1", 0), rows[0][1] * 3), (("c2", 0), rows[0][1] * 3), (("d", 0), "a" * 200), (("e", 1), "a" * 90), (("f", 0), "")]
    df = spark.createDataFrame([(a, b, t, 1) for (a, b), t in rows] + [(rows[0][0][0], rows[0][0][1], rows[0][1], 2), ("n", 0, None, 1)], "book_id string, stream int, norm_text string, sid int")
    for n in (8, 20):
        got = shared_spans.shared_spans(df, ["book_id", "stream"], "norm_text", n).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_spans(rows, n)
    assert shared_spans.shared_spans(df.limit(0), ["book_id", "stream"], "norm_text").count() == 0


def test_two_texts_under_one_key(spark):
    own, other = "a passage of one record that no other has in it", "a passage that stands in two of the records here"
    rows = [(("b", 0), own + " one " + other), (("b", 0), "two " + own), (("c", 0), "three " + other), (("d", 1), own[:10]), (("e", 0), "four four four four"), (("e", 1), "four four four four"), (("e", 1), "5 four four four four")]
    df = spark.createDataFrame([(a, b, t) for (a, b), t in rows], "book_id string, stream int, norm_text string")
    got = [tuple(r) for r in shared_spans.shared_spans(df, ["book_id", "stream"], "norm_text", 12).collect()]
    want = brute_spans(rows, 12)
    assert sorted(got) == sorted(want) and not any(k[:2] == ("b", 0) and k[3] <= len(own) for k in want)


def test_shared_by_page(spark):
    spans = spark.createDataFrame([("b", 0, 5, 20)], "book_id string, stream int, span_start int, span_end int")
    m = spark.createDataFrame([("b", 0, 1, 0, 10, 3, 0.5), ("b", 0, 1, 0, 10, 3, 0.5), ("b", 0, 2, 10, 30, 0, 0.1), ("b", 0, 3, None, None, 0, 0.0), ("c", 0, 1, 0, 4, 1, 1.0)], "book_id string, stream int, page int, start_pos int, end_pos int, anchors_hit int, score double")
    assert sorted((r.book_id, r.page, r.n_chars, r.n_shared) for r in shared_spans.shared_by_page(spans, m).collect()) == [("b", 1, 10, 5), ("b", 2, 20, 10), ("b", 3, 0, 0), ("c", 1, 4, 0)]


def test_shared_by_stream(spark):
    rows = [("b", 0, "x" * 5 + "s" * 15 + "y" * 10, 1), ("b", 0, "x" * 5 + "s" * 15 + "y" * 10, 2), ("b", 1, "note", 1), ("c", 0, None, 1), ("d", 0, "", 1), (None, 0, "s" * 15, 1)]
    streams = spark.createDataFrame(rows, "book_id string, stream byte, norm_text string, key int")
    spans = shared_spans.shared_spans(streams, ["book_id", "stream"], "norm_text", 12)
    got = shared_spans.shared_by_stream(spans, streams).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("b", 0, 30, 15), ("b", 1, 4, 0), ("c", 0, 0, 0), ("d", 0, 0, 0), (None, 0, 15, 15)], key=repr)
    assert dict(shared_spans.shared_by_stream(spans.limit(0), streams).dtypes)["stream"] == "int"
    assert shared_spans.shared_by_stream(spans.limit(0), streams.limit(0)).count() == 0


def test_repeated_lines(spark):
    rows = [(i, "b", i, ["عنوان الكتاب %d" % i, "سطر فريد " + "اب"[i % 2] * i, None, "(%d)" % i], 1) for i in range(1, 9)]
    rows += [(50, "b", 1, ["عنْوان  الكتاب"], 1), (50, "b", 1, ["عنْوان  الكتاب"], 1), (60, "c", 1, ["عنوان الكتاب"], 1), (70, "b", None, ["عنوان الكتاب"], 1), (80, "b", 3, None, 1)]
    df = spark.createDataFrame(rows, "block_id long, book_id string, page int, lines array<string>, key int")
    got = {tuple(r) for r in repeated_lines.find_repeated_lines(df).collect()}
    assert got == {(i, 0) for i in range(1, 9)} | {(50, 0), (70, 0)}
    clean = {r.block_id: (r.text, r.n_removed) for r in repeated_lines.remove_repeated_lines(df).collect()}
    assert clean[50] == ("", 1) and clean[60] == ("عنوان الكتاب", 0) and clean[80] == (None, 0) and clean[1][1] == 1 and "(1)" in clean[1][0]
    assert repeated_lines.find_repeated_lines(df.limit(0)).count() == 0 and repeated_lines.find_repeated_lines(df, 9).count() == 0


def test_page_bitmaps(spark):
    rng = random.Random(2)
    rows = [(f"b{rng.randrange(3)}", bytes([rng.randrange(4)]), rng.choice([0, 5, 63, 64, 65, 127, 128, 5000, rng.randrange(9000)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "book_id string, key binary, page int")
    got = repeated_lines.page_bitmaps(df, 5)
    assert {(r.book_id, bytes(r.key)): r.n_pages for r in got.collect()} == {k: n for k, n in ((k, len({p for *x, p in rows if tuple(x) == k})) for k in {r[:2] for r in rows}) if n >= 5}
    asked = got.crossJoin(spark.createDataFrame([(p,) for p in (0, 1, 5, 63, 64, 66, 128, 5000, None)], "page int"))
    for r in asked.select("book_id", "key", "page", repeated_lines.in_bitmap(F.col("bitmap"), F.col("page")).alias("x")).collect():
        assert r.x == (r.page is None or (r.book_id, bytes(r.key), r.page) in set(rows))


def test_repeated_lines_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("block_id"), F.lit("b").alias("book_id"), (F.col("id") % 200).cast("int").alias("page"), F.array(F.lit("same line"), F.concat(F.lit("own "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("lines"))
    assert repeated_lines.find_repeated_lines(df).count() == 3000


SAME = [("ﻛﺘﺎﺏ", "كتاب"), ("ｆｕｌｌ", "full"), ("oﬃce", "office"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("pаge", "page"), ("كتاب قدیم", "كتاب قديم"), ("١٢٣", "۱۲۳"), ("دا‌ر", "دار"), ("على", "علی")]
OTHER = [("أ", "ا"), ("ي", "ی"), ("٤", "۴"), ("A", "a"), ("كتابة", "كتابه"), ("é", "e"), ("می‌رود", "میرود"), ("x²", "x2"), ("a, b", "a b"), ("a b", "b a"), ("كَ", "ك"), ("گل", "كل")]


def test_canonical():
    assert all(lookalikes.canonical(a) == lookalikes.canonical(b) for a, b in SAME), [p for p in SAME if lookalikes.canonical(p[0]) != lookalikes.canonical(p[1])]
    assert all(lookalikes.canonical(a) != lookalikes.canonical(b) for a, b in OTHER), [p for p in OTHER if lookalikes.canonical(p[0]) == lookalikes.canonical(p[1])]
    for a, b in SAME + OTHER:
        for x in (a, b):
            assert lookalikes.canonical(lookalikes.canonical(x)) == lookalikes.canonical(x)
    assert lookalikes.canonical("ABC", fold_case=True) == "abc"


def test_canonical_of_composed_and_decomposed():
    marks = "".join(map(chr, range(0x300, 0x345)))
    letters = "".join(lookalikes.SAME_SHAPE.values()) + "".join(lookalikes.SAME_SHAPE) + "ыйійяαηωאאهيوا"
    for word in ("ёлка", "їжак", "καλό", "Ёж", "Ὀδύσσεια"):
        a, b = (lookalikes.canonical(unicodedata.normalize(f, word)) for f in ("NFC", "NFD"))
        assert a == b == lookalikes.canonical(a), word
    for x in letters:
        for m in marks + "ٕٓٔ":
            for y in (x + m, x + m + "̣"):
                a, b = (lookalikes.canonical(unicodedata.normalize(f, y)) for f in ("NFC", "NFD"))
                assert a == b == lookalikes.canonical(a), (x, m)
    assert lookalikes.canonical("ё") == lookalikes.canonical("ë") != lookalikes.canonical("e")


def test_lookalike_classes(spark):
    rows = [("text", i, "page", 0) for i in range(1, 6)] + [("text", i, "pаge", 0) for i in (6, 7)] + [("text", 8, "ｐａｇｅ", 0), ("text", 8, "ｐａｇｅ", 0), ("text", 9, "other", 0), ("text", 10, None, 0)]
    df = spark.createDataFrame(rows, "field string, id long, text string, links int")
    got = {r.id: (r.class_id, r.links) for r in lookalikes.lookalike_classes(df).collect()}
    assert got == {i: (1, 3) for i in range(1, 6)} | {6: (1, 6), 7: (1, 6), 8: (1, 7)}
    pairs = lookalikes.lookalike_pairs(df).collect()
    assert len(pairs) == len(set(pairs)) == sum(n for _, n in got.values()) / 2
    assert lookalikes.lookalike_classes(df.limit(0)).count() == 0


def test_lookalike_pairs(spark):
    rows = [("text", 1, "page"), ("text", 2, "pаge"), ("text", 2, "pаge"), ("text", 3, "page"), ("raw_text", 4, "ｐａｇｅ"), ("text", 5, None), ("text", 6, ""), ("text", 7, "​"), ("text", 8, "Page")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "field string, id long, text string, canon int")
    assert {tuple(r) for r in lookalikes.lookalike_pairs(df).collect()} == {("text", 1, 2), ("text", 2, 3)}
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0
    got = {r.id: r.c for r in df.select("id", lookalikes.canonical_udf()("text").alias("c")).collect()}
    assert got[2] == "page" and got[5] is None and got[6] == ""


def test_tokens_equal_a_library(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    texts = ["", " ", "aaaa<|endoftext|> it's", "قال الكاتب\n\n  ۱۲", "日本語" * 300, "x" * 3000, "é‌ ", "12345 67"]
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
        other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [x.tolist() for x in tokenize.byte_encoder(name).encode(texts)] == [other.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(99, None, 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenize.encode_documents(df).collect()}
    assert got[99] == [] and got[0] == [] and len(got) == 9 and all(isinstance(x, int) for x in got[2])


def test_token_counts():
    import public_tokenizers as P
    import sentencepiece

    from quire.llm.token_counts import counter

    texts = ["", "a b\nc  d", " x", "x\n", "\nx", "قال الكاتب\nثم مضى", "a\n\nb c", "é ▁ q", None, "one two\nthree four"]
    got = counter(("byte_bpe_50k", "piece_bpe_32k"))(texts)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert got[:, 1].tolist() == [len(sp.encode(t or "")) for t in texts]
    assert got[:, 0].tolist() == [len(x) for x in tokenize.byte_encoder("byte_bpe_50k").encode(texts)]


def test_packing_is_valid_and_tight():
    rng = random.Random(8)
    size = [rng.randrange(1, 900) for _ in range(600)]
    bins = packing.evolve(size, 1000, 1, [])
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(sum(size[i] for i in b) <= 1000 for b in bins)
    assert len(bins) <= -(-sum(size) // 1000) * 1.02
    a, b = packing._solution(list(range(600)), size, 1000, rng, 0.0), packing._solution(list(range(600)), size, 1000, rng, 0.2)
    kid = packing.crossover(a, b, size, 1000, rng)
    assert sorted(i for x in kid[0] for i in x) == list(range(600)) and kid[1] == [sum(size[i] for i in x) for x in kid[0]]


def test_least_bins():
    rng = random.Random(12)

    def best(size, room):  # every way to fill, by brute force
        bins = []

        def put(i, most):
            if i == len(size):
                return len(bins)
            for j in range(len(bins)):
                if bins[j] + size[i] <= room:
                    bins[j] += size[i]
                    most = min(most, put(i + 1, most))
                    bins[j] -= size[i]
            if len(bins) + 1 < most:
                bins.append(size[i])
                most = min(most, put(i + 1, most))
                bins.pop()
            return most

        return put(0, len(size) + 1)

    for _ in range(150):
        room = rng.randrange(5, 30)
        size = sorted((rng.randrange(0, room + 1) for _ in range(rng.randrange(1, 8))), reverse=True)
        assert -(-sum(size) // room) <= packing.least_bins(size, room) <= best(size, room)
    assert packing.least_bins([], 9) == 0 and packing.least_bins([0, 0], 9) == 1 and packing.least_bins([510, 600, 700], 1000) == 3


def test_genetic_search_beats_its_starts():
    rng = random.Random(5)
    triples = [(a, b, 1000 - a - b) for a, b in ((rng.randrange(260, 400), rng.randrange(260, 400)) for _ in range(60))]
    for size in ([x for t in triples for x in t], [rng.randrange(250, 501) for _ in range(900)]):
        n = list(range(len(size)))
        start = min(len(packing._solution(n, size, 1000, random.Random(s), x)[1]) for s, x in ((1, 0.0), (2, 0.1), (3, 0.15)))
        best = packing.evolve(size, 1000, 7, [])
        assert sorted(i for b in best for i in b) == n and all(sum(size[i] for i in b) <= 1000 for b in best)
        assert packing.least_bins(size, 1000) <= len(best) <= 0.97 * start


def test_packing_on_islands(spark):
    rng = random.Random(6)
    rows = [(1, 1000, i % 2, i, 0, rng.randrange(250, 501)) for i in range(400)]
    got = packing.pack_blocks(spark.createDataFrame(rows, "spec_id int, room int, block long, doc_id long, piece int, tokens int")).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    loads = Counter()
    for r in got:
        loads[r.block, r.bin] += r.tokens
    start = sum(len(packing._solution(list(range(200)), [r[5] for r in rows if r[2] == b], 1000, rng, 0.0)[1]) for b in (0, 1))
    assert max(loads.values()) <= 1000 and len(loads) < start


def test_packing_of_what_cannot_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    sizes = []
    inner = packing.pack_blocks
    monkeypatch.setattr(packing, "pack_blocks", lambda items: sizes.append(items.groupBy("spec_id", "block").count().agg(F.max("count")).first()[0]) or inner(items))
    monkeypatch.setattr(packing, "document_sizes", lambda docs, names, folder=None: docs.select("doc_id", F.array((510 + F.col("doc_id") % 190).cast("long")).alias("sizes")))
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 1000)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack_documents(docs, specs)
    assert got.select("container").distinct().count() == 1000 and max(sizes) <= 100 and len(sizes) == 1


def test_packing_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60))), 7) for i in range(150)] + [(200, "word " * 500, 7), (201, None, 7), (202, "", 7), (203, "a b", 7), (203, "a b", 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, room int")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 100), (2, "byte_bpe_50k", 64), (3, "byte_bpe_50k", None)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack_documents(d, specs).collect()
    for spec, room in ((1, 100), (2, 64)):
        rows = [r for r in got if r.spec_id == spec]
        loads = Counter()
        for r in rows:
            loads[r.container] += r.tokens
        assert max(loads.values()) <= room and {r.doc_id for r in rows} == {x[0] for x in docs}
        pieces = sorted((r.piece, r.tokens) for r in rows if r.doc_id == 200)
        assert [p for p, _ in pieces] == list(range(len(pieces))) and all(t == room for _, t in pieces[:-1])
        assert all(sum(1 for r in rows if r.doc_id == i) == 1 for i in (0, 201, 202, 203))
        assert len(loads) <= -(-sum(loads.values()) // room) * 1.05 + 1
    assert packing.pack_documents(d.limit(0), specs).count() == 0 and packing.pack_documents(d, specs.limit(0)).count() == 0


def site(rng, n):
    nouns = "garden lantern harbour mill bridge valley orchard comet riddle barley ledger weaver kiln toll saddle dune".split()
    verbs = "grinds opens keeps gathers waters carries repairs follows".split()
    sentence = lambda k: " ".join(x for _ in range(k) for x in (rng.choice(["since", "while", "so"]), rng.choice(verbs), rng.choice(nouns), rng.choice(["under", "near", "of"]), rng.choice(nouns))).capitalize() + "."
    pages, want = [], set()
    for i in range(n):
        title = f"{rng.choice(nouns)} {rng.choice(nouns)}"
        top = [("Home | Books | Contact", 1), (f"Most read this week: {rng.choice(nouns)} {rng.choice(nouns)}", 1)]
        own = [(title, 0), (sentence(4), 0), (f"Órbita e maçã, livro {i}", 0), (sentence(5), 0)]
        end = [(f"© {2000 + i % 20} h.example. All rights reserved.", 1), (f"{rng.choice(nouns)} {rng.choice(nouns)} ({i})", 1), (f"{rng.choice(nouns)} {rng.choice(nouns)}", 1), ("", 0)]
        lines = top + own + end
        pages.append((i, "h.example", f"b{i % 5}", title, "\n".join(x for x, _ in lines), None if i % 2 else "(1) " + sentence(3) + "\n↑ back to the text", 1))
        want |= {(i, "body", n) for n, (_, f) in enumerate(lines) if f}
        if not i % 2:
            want.add((i, "footnotes", 1))
    return pages, want


def test_page_furniture(spark):
    pages, want = site(random.Random(6), 60)
    pages += [pages[0], (500, None, None, None, None, None, 1), (501, "h.example", "b1", None, "", " \n", 1)]
    df = spark.createDataFrame(pages, "page_id long, host string, book_id string, title string, body string, footnotes string, key int")
    got = {tuple(r) for r in page_wrappers.page_furniture(df).collect()}
    assert len(got - want) == 0 and len(want - got) <= 0.03 * len(want)
    own = {(r.page_id, r.field): r.text for r in page_wrappers.own_text(df).collect()}
    assert "Órbita" in own[0, "body"] and "Home" not in own[0, "body"]
    assert page_wrappers.page_furniture(df.limit(0)).count() == 0


def test_long_furniture(spark):
    rng = random.Random(7)
    whole = "we use cookies so that this library of old books stays open to all who read here and to keep the lamps lit, see our policy"
    share = "share this page with your friends and tell them that you have read the chapter named {} today"
    edition = "in the second year the miller of the valley sold his mill and went over the hills to the sea with his dog"
    pages, want = [], set()
    for i, (page, *rest) in enumerate(site(rng, 40)[0]):
        body = rest[3].split("\n")
        extra = [whole, share.format(rng.choice(WORDS["ru"])), whole + " " + whole]
        if i < 4:
            body.insert(5, edition)  # once in each of four books: editions
        want |= {(page, "body", len(body) + k) for k in range(3)}
        pages.append((page, *rest[:3], "\n".join(body + extra), *rest[4:]))
    df = spark.createDataFrame(pages, "page_id long, host string, book_id string, title string, body string, footnotes string, key int")
    got = {tuple(r) for r in page_wrappers.page_furniture(df).collect()}
    assert want <= got
    bodies = {p[0]: p[4].split("\n") for p in pages}
    assert all(len(bodies[p][n].split()) < page_wrappers.PARAGRAPH or (p, f, n) in want for p, f, n in got if f == "body")
    plain = spark.createDataFrame([(p[0], *p[1:4], "\n".join(bodies[p[0]][:-3]), *p[5:]) for p in pages], df.schema)
    assert {r for r in map(tuple, page_wrappers.page_furniture(plain).collect())} == got - want


def test_books_are_counted_not_hashed(spark):
    import xxhash

    place = {}
    for i in range(1000):  # two books of one place among 61
        a, b = place.setdefault(xxhash.xxh3_64_intdigest(f"b{i}".encode()) % 61, f"b{i}"), f"b{i}"
        if a != b:
            break
    pages = [(page, host, (a, b)[page % 2], *rest) for page, host, _, *rest in site(random.Random(8), 30)[0]]
    df = spark.createDataFrame(pages, "page_id long, host string, book_id string, title string, body string, footnotes string, key int")
    found = page_wrappers.infer_wrappers(df)
    assert found.where("host = 'h.example' AND kind = 'line'").count() > 0
    one = df.withColumn("book_id", F.lit("b0"))
    assert page_wrappers.infer_wrappers(one).count() == 0


def test_alignment_of_patterns():
    rng = random.Random(3)
    streams = [x.split() for x in ("most read : a b", "most read : c", "most read : x y z", "most read : a read")]
    p = page_wrappers.align(streams)
    assert p == ["most", "read", ":", "*"] and all(page_wrappers.covers(p, s) for s in streams) and not page_wrappers.covers(p, "most : x".split())
    assert page_wrappers.align(["a x b".split(), "a b".split()]) == ["a", "*", "b"] and page_wrappers.align([["a", "b"]]) == ["a", "b"]
    parts = [[rng.choice("abcd") for _ in range(rng.randrange(1, 7))] + ["end"] for _ in range(200)]
    for _ in range(30):  # whatever the order and the parts met first
        few = rng.sample(parts, 5)
        cut = rng.randrange(1, 5)
        got = set.intersection(*(set(page_wrappers.items(s)) for s in few[:cut])) & set.intersection(*(set(page_wrappers.items(s)) for s in few[cut:]))
        assert page_wrappers.pattern(min(few), got) == page_wrappers.align(rng.sample(few, 5))
    assert page_wrappers.markup('<li class="x"><a href="y">t</a></li>') == "li.x>a"


def test_repeated_groups():
    assert page_wrappers.runs("hpp-sc", "body", False) == [(4, 6, True)] and page_wrappers.runs("pssp", "body", False) == [(1, 3, False)]
    assert page_wrappers.runs("ssp", "body", True) == [] and page_wrappers.runs("ss", "footnotes", False) == [] and page_wrappers.runs("bs", "body", True) == [(0, 2, None)]


def test_wrappers_do_not_hang_on_layout(spark):
    df = spark.createDataFrame(site(random.Random(9), 40)[0], "page_id long, host string, book_id string, title string, body string, footnotes string, key int")
    one, many = (sorted(map(tuple, page_wrappers.infer_wrappers(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many and {r[2] for r in one} >= {"line", "run"}


def test_hosts_lists_too_large_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(site(random.Random(10), 40)[0], "page_id long, host string, book_id string, title string, body string, footnotes string, key int")
    want = {tuple(r) for r in page_wrappers.page_furniture(df).collect()}
    monkeypatch.setattr(page_wrappers, "SMALL", -1)
    monkeypatch.setattr(page_wrappers, "SALTED", 7)
    assert {tuple(r) for r in page_wrappers.page_furniture(df).collect()} == want and want


def test_spam_shapes(spark):
    rng = random.Random(5)
    prose = [(i, " ".join(f"{rng.choice(['since', 'while'])} the {rng.choice(WORDS['fr'])} of {rng.choice(WORDS['fr'])} and {rng.choice(WORDS['fr'])} was near the {rng.choice(WORDS['fr'])}." for _ in range(6)), "en") for i in range(60)]
    items = [rng.choice(["loom", "kiln", "barley", "tile", "dune"]) for _ in range(60)]
    spam = [(100, " | ".join(items), "en"), (101, "\n".join(f"#{x}" for x in items), "en"), (102, "\n".join(f"- {x} - https://s.example/{x}?id={i}" for i, x in enumerate(items)), "en"), (103, "\n".join(f"{x} kit / AB-{i + 1000} | {i} NEW" for i, x in enumerate(items)), "en"), (104, prose[0][1][:60] + "\n" + ", ".join(items), None)]
    fine = [(200, "\n".join(f"{x}: the thing of the {x} was near and of use." for x in items[:8]), "en"), (201, "\n".join(["the loom of the mill was near"] * 4 + [p[1][:40] for p in prose[:8]]), "en"), (202, prose[1][1] + "\n#loom #kiln\nhttps://s.example/a", "en"), (203, None, None), (204, "", "en"), (205, "  \n ", "en"), (206, "loom kiln", "en"), (207, prose[2][1] * 300, "en")]
    df = spark.createDataFrame([(*r, 1) for r in prose + spam + fine + [spam[0]]], "doc_id long, text string, lang string, share int")
    got = Counter(r.doc_id for r in spam_shapes.spam_documents(df).collect())
    assert got == {100: 2, 101: 1, 102: 1, 103: 1, 104: 1}
    assert spam_shapes.spam_documents(df.limit(0)).count() == 0


def test_shapes():
    words = spam_shapes.Words({"the", "of"})
    cut = lambda x: spam_shapes._cut(x, words)
    assert cut("a | b | c | d")[1] == "|" and cut("a, b, c, d")[1] == "," and cut("a b c d") == (["a b c d"], "") and cut("the loom, of it. Next")[0] == ["the loom, of it.", "Next"]
    names = {spam_shapes.shape("loom kit", words, sep)[0] for sep in ("|", ",", "")}
    assert len(names) == 3 and spam_shapes.shape("the loom of it.", words) == ("word 3-5 c. s", True)
    assert spam_shapes.shape("LOOM AB-12", words)[0] == "code 1-2 C x" and spam_shapes.shape("see https://a.example", words)[1] is False and spam_shapes.shape("-", words) == ("word 0 c x", False)
    total, groups = spam_shapes.shape_groups("loom | kiln | tile | dune\nthe loom of the mill.", words)
    assert total == 36 and groups == {"word 1-2 c | x": [4, 16]}


def test_many_shapes_are_no_pile(spark):
    kinds = ["loom", "Loom Kiln Tile", "#loom", "AB-12", "loom kiln tile dune", "Loom.", "https://s.example/a", "loom kiln tile dune loft mill"]
    rows = [(1, "\n".join(x for k in kinds for x in [k] * 3)), (2, "\n".join(["loom", "AB-12"] * 12)), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.share for r in spam_shapes.spam_documents(df, {"the"}, over=0.0).collect()}
    assert 0 < got[1] < 1 and got[2] == 1.0 and 3 not in got


def test_common_words_of_short_texts(spark):
    rng = random.Random(3)
    small = "ka lo mi su ne ra to vi pe du sa lu".split()
    name = lambda: "".join(rng.choices("bdgkmnprstz", k=6))
    short = [(i, " ".join(x for w in rng.sample(small, 5) for x in (w, name())) + ".", "xx") for i in range(80)]
    piles = [(100 + i, " ".join(["loom", "kiln", "tile"] * 40), "xx") for i in range(6)]
    df = spark.createDataFrame(short + piles, "doc_id long, text string, lang string")
    assert spam_shapes.common_words(df) == set(small)
    assert {r.doc_id for r in spam_shapes.spam_documents(df).collect()} == {p[0] for p in piles}


def test_nfc_input_is_stable():
    assert spam_shapes.plain("é") == unicodedata.normalize("NFC", "é")
