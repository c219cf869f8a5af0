import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidara.functions import records as rec, similarity as sim, terms as tm, text as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_clean_keeps_case_and_digits(spark):
    assert one(spark, tx.clean(F.col("t")), t="﻿ Aـــb  https://x.y/z me@a.org ٣\t\n") == "Ab ٣"
    assert one(spark, tx.clean(F.col("t")), t=None) == ""


def test_variants_differ(spark):
    t = "أهْلاً، وسهلا!! ٣٥"
    assert one(spark, tx.dedupe_key(F.col("t")), t=t) == "اهلا، وسهلا 35"
    assert one(spark, tx.matching_form(F.col("t")), t=t) == "اهلا, وسهلا! 35"
    assert one(spark, tx.letter_form(F.col("t")), t=t) == "اهلا، وسهلا!! ٣٥"


def test_nfkc_only_where_needed(spark):
    texts = ["plain", "ﬁne ﻻ", None, "é", "Å²"]
    df = tx.with_nfkc(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = {r["i"]: r["t"] for r in df.collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) if t else t for i, t in enumerate(texts)}


def test_nfkc_of_several_columns_in_one_worker(spark):
    df = tx.with_nfkc(spark.createDataFrame([("ﬁ", "x²", None), (None, None, "ａ")], "a string, b string, c string"), "a", "b", "c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1  # a second one is a second worker in every task
    assert [tuple(r) for r in df.collect()] == [("fi", "x2", None), (None, None, "a")]


def test_mojibake(spark):
    df = tx.mojibake(spark.createDataFrame([("سلام".encode().decode("latin-1"),), ("Ø alone €",), ("ok",)], "t string"), "t")
    assert {r[0] for r in df.collect()} == {"سلام", "Ø alone €", "ok"}


def test_truncate_and_compact(spark):
    assert one(spark, tx.truncate(F.col("t"), 3), t="abcdef") == "abc...[truncated]"
    assert one(spark, tx.compact(F.col("t"), 8), t="ab   cd efghi") == "ab cd..."


def test_search_terms_fall_back_to_stopwords(spark):
    assert one(spark, tm.search_terms(F.col("t")), t="ما هو العلاج العلاج") == ["العلاج"]
    assert one(spark, tm.search_terms(F.col("t")), t="ما هو") == ["ما", "هو"]


def test_anatomy_forms(spark):
    got = one(spark, tm.anatomy_terms(tm.token_set(F.col("t"))), t="وبطني بالرأس ركبتها")
    assert set(got) == {"بطن", "راس"} or set(got) == {"بطن", "راس", "ركبه"}


def test_matching_ratio_and_bound(spark):
    pairs = [("kitten", "sitting"), ("abc", "abc"), ("", "a"), ("progesteron", "progesterone")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.matching_ratio(F.col("a"), F.col("b")).alias("r"), sim.ratio_bound(F.col("a"), F.col("b")).alias("u"))
    for r in df.collect():
        assert r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["u"] >= r["r"]


def test_fuzzy_pairs_lose_none(spark):
    words = ["alpha", "alpah", "alphas", "beta", "betta", "gamma", "gama", "x"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {(r[0], r[1]) for r in sim.fuzzy_pairs(df, df, 0.78).collect()}
    assert got == {(a, b) for a in words for b in words if difflib.SequenceMatcher(None, a, b).ratio() >= 0.78}


def _plain_pairs(left, right, floor):
    return {(a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= floor}


def _mutated(words, rng, letters):
    out = set(words)
    for w in words:
        for _ in range(3):
            c = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(c) + 1)
                kind = rng.random()
                if kind < 0.4:
                    c.insert(at, rng.choice(letters))
                elif c and kind < 0.7:
                    c.pop(min(at, len(c) - 1))
                elif c:
                    c[min(at, len(c) - 1)] = rng.choice(letters)
            out.add("".join(c))
    return sorted(out)


@pytest.mark.parametrize("floor", [0.4, 0.78, 0.9, 1.0])
def test_near_pairs_equal_brute_force(spark, floor):
    """Random words of few letters, with repeats, an astral letter and lengths from 0 to 24: no pair is lost at any floor."""
    rng = random.Random(5)
    letters = "abcé\U0001d4d0ش"
    words = _mutated(["".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) for _ in range(40)], rng, letters)
    left, right = words[::2], words[1::3] + words[:40:2]
    df = lambda ws: spark.createDataFrame([(w,) for w in [*ws, None, ws[0]]], "t string")
    got = [tuple(r) for r in sim.fuzzy_pairs(df(left), df(right), floor).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_pairs(left, set(right), floor)


def test_few_candidates_are_compared(spark):
    """Of the pairs of a vocabulary whose lengths allow the floor, under one in twenty are compared, and none is lost."""
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("t")).filter("length(t) > 2").distinct()
    words = _mutated([r["t"] for r in text.orderBy("t").limit(100).collect()], random.Random(3), "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for floor in (sim.IDENTITY_FLOOR, sim.NEAR):
        possible = sum(1 for a in words for b in words if a != b and a and b and 2 * min(len(a), len(b)) >= floor * (len(a) + len(b)))
        assert sim.near_candidates(df, df, floor).count() < 0.05 * possible
        got = {tuple(r) for r in sim.fuzzy_pairs(df, df, floor).collect()}
        assert got == _plain_pairs(words, words, floor) and len(got) > len(words)


def test_near_identity(spark):
    rows = [("a", ["metformin", "therapy"], ["metformine", "x"]), ("a", ["metformin", "therapy"], ["therapist"]), ("b", ["asthma"], ["asthma", "asthmaa"]), ("b", ["asthma"], []), ("c", [], ["metformin"]), ("d", ["migraine"], None), (None, ["colitis"], ["colitiss"])]
    df = sim.with_near_terms(spark.createDataFrame(rows, "k string, l array<string>, r array<string>"), "k", "l", ["r"], sim.IDENTITY_FLOOR, "near")
    got = df.select("k", "l", "r", sim.identity_similarity(F.col("l"), F.col("r"), F.col("near")).alias("v"), sim.near_matches(F.col("l"), F.col("r"), F.col("near"), sim.IDENTITY_FLOOR).alias("hits")).collect()
    assert len(got) == len(rows)
    for r in got:
        left, right = set(r["l"]), set(r["r"] or [])
        best = max((difflib.SequenceMatcher(None, a, b).ratio() for a in left for b in right), default=0.0)
        wanted = 0.0 if not left or not right else len(left & right) / min(len(left), len(right)) if left & right else best if best >= sim.IDENTITY_FLOOR else 0.0
        if r["k"] is not None and r["r"] is not None:
            assert r["v"] == wanted, r
            assert r["hits"] == [a for a in r["l"] if any(difflib.SequenceMatcher(None, a, b).ratio() >= sim.IDENTITY_FLOOR for b in right)]
    assert {r["v"] for r in got} > {0.0, 1.0}


def test_records(spark):
    assert one(spark, rec.json_object(F.col("t")), t='x ```json {"a": {"b": 1}} ``` y') == '{"a": {"b": 1}}'
    assert one(spark, rec.json_object(F.col("t")), t="none") is None
    assert one(spark, rec.aliases(F.col("t"), F.lit("A")), t='[" b ", "A", "", "b", "c"]') == ["b", "c"]
    assert one(spark, rec.unit(F.col("t")), t="1.7") == 1.0
    assert one(spark, rec.unit(F.col("t")), t="zzz") == 0.0
    assert one(spark, rec.flag(F.col("t")), t=" Yes ") is True
    assert one(spark, rec.null_like(F.col("t")), t=" NaN ") == ""
    assert one(spark, rec.passage(F.col("t"), F.lit(""), F.lit(None).cast("string"), F.lit("b")), t=" a ") == "passage: a b"


def test_replacements_pass_over_what_stays(spark):
    """Single spaces are no match, characters are replaced in one pass, and the forms equal the steps one after the other."""
    assert not one(spark, F.col("t").rlike(tx._SPACES), t="a b c") and not one(spark, F.col("t").rlike(tx._SIGNS), t="a b c")
    drop, bits = F.regexp_replace, ["a", "É", " ", "  ", "\t", " ", "　", "\u0085", "﻿", "ـ", "ً", "أ", "٣", "؟", "،", "!", "!", "..", "a@b.c", "HTTP://x", "wWw.y", "“", "😀", "٪"]
    rng = random.Random(3)
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))),) for _ in range(2000)] + [(None,)], "t string")
    c = F.coalesce("t", F.lit(""))
    links = lambda c: drop(drop(c, tx.URL, " "), tx.EMAIL, " ")
    line = lambda c: F.trim(drop(c, tx.SPACE, " "))
    cleaned = line(drop(links(F.replace(c, F.lit("﻿"), F.lit(""))), "ـ+", ""))
    key = F.lower(line(drop(F.translate(drop(F.translate(cleaned, *tx.DIGITS), tx.DIACRITICS, ""), *tx.LETTERS), rf"[^{tx.WORD}\x{{0600}}-\x{{06FF}}]+", " ")))
    plain = F.translate(F.translate(drop(drop(F.translate(links(c), *tx.DIGITS), "ـ+", ""), tx.DIACRITICS, ""), *tx.LETTERS), *tx.PUNCTUATION)
    match = F.lower(line(drop(plain, rf"([{tx.REPEATABLE}])\1+", "$1")))
    for form, steps in ((tx.clean, cleaned), (tx.dedupe_key, key), (tx.matching_form, match)):
        assert df.select("t", form(F.col("t")).alias("x"), steps.alias("y")).localCheckpoint().filter("NOT (x <=> y)").collect() == []


def test_steps_run_once(spark):
    """Each step of the normal form stands once in the plan that names them."""
    df = tx.with_normalization_steps(spark.createDataFrame([("أ  https://a.b ؟؟",)], "t string"), "t", "norm", "steps")
    assert df.first()["steps"] == ["remove_urls", "normalize_arabic_letter_variants", "normalize_punctuation", "collapse_repeated_punctuation", "collapse_whitespace"]
    assert df._jdf.queryExecution().executedPlan().toString().count("translate(") == 1


def test_tokens_need_no_single_spaces(spark):
    odd = ["", "a  b\t\u00a0c", "wait...what!!", "؟؟نعم،،لا؛؛", "ΟΔΟΣ..ΑΣ", "x@y.zz a@@b", "www.a.b  c://d https://e..f g", "İstanbul  ÇA", "1,,2..3 ٣٫٤", "\u200e..\u0640ab\u064b\u064b", "a\u2028\u2029b", "؟", "  "]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tm.token_set(F.col("t")).alias("a"), F.array_distinct(tm.all_tokens(tx.query_form(F.col("t")))).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect()) and df.filter("size(a) > 1").count() > 6
