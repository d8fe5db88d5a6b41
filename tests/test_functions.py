import random
from collections import Counter

from pyspark.sql import functions as F

from quire.functions import cuts, digits, urls
from quire.functions.normalize import has_compatibility_chars, normalize_map_udf, normalize_native, normalize_text, normalize_udf, normalize_with_map
from quire.functions.similarity import as_text, dice, grams


def test_normalisation_of_strings():
    out = normalize_text("قَالَ ـــ في ۱۲۳ كِتَابٌ")
    assert "123" in out and "ـ" not in out and " " not in out and "َ" not in out
    assert normalize_text("éÉ") == "eé"  # marks go one by one, composed letters stay
    assert normalize_text("ﻻ ﬁ Ⅳ") == "لا" + "fi" + "iv"


def test_offset_map():
    raw = "ﷲ أ-ب ٣‌"
    norm, places = normalize_with_map(raw)
    assert len(norm) == len(places) and all(0 <= p < len(raw) for p in places) and places == sorted(places)


def test_udfs_and_nulls(spark):
    df = spark.createDataFrame([(1, "أحمد ٣"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: (r.n, r.m and (r.m.norm, r.m.norm_map)) for r in df.select("id", normalize_udf("text").alias("n"), normalize_map_udf("text").alias("m")).collect()}
    assert got[1] == ("احمد3", ("احمد3", [0, 1, 2, 3, 5])) and got[2] == ("", ("", [])) and got[3][0] is None


def test_native_equals_kernel(spark):
    texts = ["Été à la GARE, ۴۲!", "ـكتاب‌ها گچ", "Сад 7", "“quoted” — dash"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", normalize_native(F.col("t")).alias("n"), has_compatibility_chars(F.col("t")).alias("c")).collect():
        assert r.n == normalize_text(r.t)
    assert spark.createDataFrame([("ﻻ",)], "t string").select(has_compatibility_chars(F.col("t"))).first()[0]


def test_dice(spark):
    rows = [(1, "abcdef", "abcdef"), (2, "abcdef", "uvwxyz"), (3, "ab", "ab"), (4, "ab", "abc"), (5, "", "abc"), (6, None, None), (7, "aaaaaa", "aaaa")]
    got = {r.id: r.dice for r in dice(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 2 * 2 / 6}
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab𝔘ا", k=rng.randrange(20))), "".join(rng.choices("ab𝔘ا", k=rng.randrange(20)))) for i in range(60)]
    got = {r.id: r.dice for r in dice(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b").collect()}
    for i, a, b in rows:
        if min(len(a), len(b)) >= 3:
            x, y = (Counter(s[n : n + 3] for n in range(len(s) - 2)) for s in (a, b))
            assert got[i] == 2 * (x & y).total() / (len(a) + len(b) - 4)


def test_grams_keep_every_sign(spark):
    t = "﻿aب𝔘c"
    df = spark.createDataFrame([(t,), ("ab",), (None,)], "t string").select(F.transform(grams(F.col("t"), 3), as_text).alias("g"))
    assert [r.g for r in df.collect()] == [[t[i : i + 3] for i in range(3)], [], []]


def test_digits_and_order(spark):
    df = spark.createDataFrame([(["من ٠١ إلى ۳۲", "x"],)], "lines array<string>")
    r = df.select(
        digits.digit_runs(F.col("lines")[0]).alias("runs"), digits.reverse_digit_runs(F.col("lines")[0]).alias("rev"),
        digits.ordered_lines(F.col("lines"), "reverse_words").alias("w"), digits.ordered_lines(F.col("lines"), "reverse_chars").alias("c"),
    ).first()
    assert [(int(x.as_is), int(x.reversed)) for x in r.runs] == [(1, 10), (32, 23)]
    assert r.rev == "من ١٠ إلى ۲۳" and r.w == "۳۲ إلى ٠١ من\nx" and r.c == "۲۳ ىلإ ١٠ نم\nx"


def test_urls(spark):
    cases = {
        "HTTP://A.Example:80//b//c?x=1#t": "http://a.example/b/c/",
        "https://a.example:8443/f.html": "https://a.example:8443/f.html",
        "https://a.example": "https://a.example/",
        "https://a.example/%D8%A8 x": "https://a.example/%D8%A8%20x/",
        " https://a.example/a.b/c ": "https://a.example/a.b/c/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in df.select("u", urls.normalize_url(F.col("u")).alias("n"), urls.normalize_udf("u").alias("k")).collect():
        assert r.n == r.k == cases[r.u]
    assert urls.normalize("/b?z=1&y=2&q=3", base="http://h.example/a/", aliases={"h.example": "www.h.example"}, keep=("z", "y")) == "https://www.h.example/b/?y=2&z=1"


def test_names_and_paths(spark):
    names = {"CON": "CON_", 'a<b>:"c"': "a_b___c_", "  .": "book", None: "book", "x" * 130: "x" * 120}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert all(names[r.n] == r.f for r in df.select("n", urls.safe_filename(F.col("n")).alias("f")).collect())
    links = {"../b.xhtml#x": ("t/b.xhtml", "x"), "#y": ("t/u/a.xhtml", "y"), "http://e.example/": None, "./c/../d": ("t/u/d", None)}
    df = spark.createDataFrame([(h,) for h in links], "h string").select("h", urls.resolve_path(F.lit("t/u/a.xhtml"), F.col("h")).alias("p"))
    assert {r.h: r.p and (r.p.path, r.p.fragment) for r in df.collect()} == links


def test_cuts(spark):
    where = {("abc («de", 6): 4, ("a ( « b", 6): 2, ("a (  b", 5): 5, ("([{x", 3): 0, ("one two three", 5): 4, ("one two", 3): 3, ("one two", 0): 0, ("abc", 2): 2, ("abcdefghijklmnopqrstuvwxyz abc", 8): 8, ("a bcd e", 4): 2, ("كتاب جديد", 7): 5}
    at = spark.createDataFrame([k for k in where], "t string, i int")
    assert {(r.t, r.i): r.c for r in at.select("t", "i", cuts.snap(F.col("t"), F.col("i")).alias("c")).collect()} == where
    rng = random.Random(1)
    rows = ["".join(rng.choices("ab ", weights=(3, 3, 1), k=40)) for _ in range(60)]
    many = spark.createDataFrame([(t, i) for t in rows for i in range(41)], "t string, i int")
    for r in many.select("t", "i", cuts.word_start(F.col("t"), F.col("i")).alias("c")).collect():
        inside = 0 < r.i < 40 and r.t[r.i - 1] != " " != r.t[r.i]
        starts = [(abs(p - r.i), p) for p in range(1, 40) if r.t[p - 1] == " " != r.t[p] and abs(p - r.i) <= 14]
        assert r.c == (min(starts)[1] if inside and starts else r.i)
    df = spark.createDataFrame([("abcdef", 10)], "t string, s int")
    r = df.select(*(cuts.slice_text(F.col("t"), F.col("s"), F.lit(lo), F.lit(hi)).alias(f"x{n}") for n, (lo, hi) in enumerate([(0, 12), (12, 14), (15, 99), (20, 30)]))).first()
    assert tuple(r) == ("ab", "cd", "f", "")
