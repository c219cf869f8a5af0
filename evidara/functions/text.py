"""Text normalisation as column expressions. The five variants differ on purpose; each lists its steps.

Character classes are spelt out, since \\w, \\s and \\b mean ASCII in the JVM's patterns. Only compatibility normalisation (NFKC) has no JVM function:
with_nfkc() sends just the values that it may change to Python. Operators apply it where texts enter: searches, links, claims.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NON_SPACE = r"[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = rf"[{WORD}\x{{0600}}-\x{{06FF}}]+"
URL = rf"(?i)https?://{_NON_SPACE}|www\.{_NON_SPACE}"
EMAIL = rf"(?U)\b[{WORD}.+-]+@[{WORD}.-]+\.[{WORD}]+\b"

# Character tables of the normal form.
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
TATWEEL = "\u0640"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
LETTERS = ("أإآٱىئؤة", "ااااييوه")
PUNCTUATION = ("؟،؛“”‘’", "?,;\"\"''")
REPEATABLE = "!?؟،,.;:"


def _drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def _runs(one: str) -> str:
    """Runs of a class of characters but a single space, which would be replaced by itself."""
    return rf"{one}(?:(?<! ){one}*|{one}+)"


# the range in front is told quickly for most characters
_SPACES = _runs(rf"[\x{{0000}}-\x{{0020}}\x{{0085}}-\x{{3000}}&&{SPACE[:-1]}]")
_SIGNS = _runs(rf"[^{WORD}\x{{0600}}-\x{{06FF}}]")


def one_line(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(_drop(c, _SPACES, " "))


def _without_urls(c: Column) -> Column:
    may = reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in ("://", "ww", "wW", "Ww", "WW")))
    return F.when(may, _drop(c, URL, " ")).otherwise(c)


def _without_emails(c: Column, text: Column) -> Column:
    """c without addresses; text is what c was made of, and has an @ if c has."""
    return F.when(F.contains(text, F.lit("@")), _drop(c, EMAIL, " ")).otherwise(c)


def _without_links(c: Column) -> Column:
    return _without_emails(_without_urls(c), c)


def _replaced(c: Column, text: Column, *tables: tuple[str, str]) -> Column:
    """c with the characters of the tables replaced and without _DROPPED, in one pass; text is what c was made of, and has all of its characters but spaces."""
    marked = text.rlike(r"[\x{0600}-\x{06FF}\x{2018}-\x{201D}]")
    return F.when(marked, F.translate(c, "".join(a for a, _ in tables) + _DROPPED, "".join(b for _, b in tables))).otherwise(c)


_DROPPED = TATWEEL + "".join(map(chr, [*range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE)]))  # tatweel and DIACRITICS


def clean(c: Column) -> Column:
    """Null is empty; drops byte-order marks, addresses and tatweel; one line. Case and digits stay."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit(""))
    return one_line(F.replace(_without_links(c), F.lit(TATWEEL), F.lit("")))


def dedupe_key(c: Column) -> Column:
    """clean(), then ASCII digits, no diacritics, plain letters, other signs (white space is one) as spaces, lower case."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit(""))
    c = _replaced(_without_links(c), c, DIGITS, LETTERS)
    return F.lower(F.trim(_drop(c, _SIGNS, " ")))


def _plain(c: Column) -> Column:
    """No addresses, ASCII digits, no tatweel and diacritics, plain letters and punctuation."""
    return _replaced(_without_links(c), c, DIGITS, LETTERS, PUNCTUATION)


def _once(c: Column) -> Column:
    """No repeated punctuation."""
    return _drop(c, rf"([{REPEATABLE}])\1+", "$1")


def matching_form(c: Column) -> Column:
    """No addresses, ASCII digits, no tatweel and diacritics, plain letters and punctuation, no repeated punctuation, one line, lower case."""
    return F.lower(one_line(_once(_plain(F.coalesce(c, F.lit(""))))))


def query_form(c: Column) -> Column:
    """matching_form() of a text that with_nfkc() has put in compatibility form."""
    return matching_form(c)


def token_text(c: Column) -> Column:
    """query_form() as far as its tokens go: repeated punctuation and white space stay, since they only stand between tokens."""
    return F.lower(_plain(F.coalesce(c, F.lit(""))))


def letter_form(c: Column) -> Column:
    """No tatweel and diacritics, plain letters, one line, lower case; digits, signs and addresses stay."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(one_line(_replaced(c, c, LETTERS)))


#: Characters that NFKC leaves alone wherever they stand: ASCII, composed Latin letters, basic Arabic letters, digits and signs.
STABLE = r"^[\x{0000}-\x{007F}\x{00C0}-\x{00FF}\x{060C}\x{061B}\x{061F}\x{0621}-\x{063A}\x{0640}-\x{064A}\x{0660}-\x{0669}\x{06F0}-\x{06F9}]*$"


def nfkc(c: Column) -> Column:
    """The compatibility form (Arrow UDF)."""
    return F.arrow_udf(_nfkc, T.StringType())(c)


def _nfkc(texts: pa.Array) -> pa.Array:
    # not over an iterator: of such functions each needs a Python worker of its own in every task
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], texts.type)


def with_nfkc(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns in compatibility form. Python sees only the values that it may change, and nulls in place of the others."""
    return df.withColumns({c: F.coalesce(nfkc(F.when(~F.coalesce(F.col(c), F.lit("")).rlike(STABLE), F.col(c))), F.col(c)) for c in columns})


def with_normalization_steps(df: DataFrame, column: str, norm: str, steps: str) -> DataFrame:
    """df with the columns norm (query_form() of the column) and steps (the names of the steps of matching_form() that change the text, in order).

    Each step is a column of its own, so it runs once. The replacements of single characters do not touch each other's, so each is told by whether its characters are there when the addresses are gone.
    """
    c = lambda name: F.col(f"_{name}")
    df = df.withColumn("_text", F.coalesce(column, F.lit("")))
    df = df.withColumn("_bare", _without_urls(c("text"))).withColumn("_links", _without_emails(c("bare"), c("text")))
    df = df.withColumn("_plain", _replaced(c("links"), c("links"), DIGITS, LETTERS, PUNCTUATION)).withColumn("_once", _once(c("plain")))
    df = df.withColumn("_spaced", _drop(c("once"), _SPACES, " ")).withColumn("_norm", F.lower(F.trim(c("spaced"))))
    changed = {
        "remove_urls": c("bare") != c("text"),
        "remove_emails": c("links") != c("bare"),
        "normalize_arabic_persian_digits": c("links").rlike(f"[{DIGITS[0]}]"),
        "remove_tatweel": F.contains(c("links"), F.lit(TATWEEL)),
        "remove_diacritics": c("links").rlike(DIACRITICS),
        "normalize_arabic_letter_variants": c("links").rlike(f"[{LETTERS[0]}]"),
        "normalize_punctuation": c("links").rlike(f"[{PUNCTUATION[0]}]"),
        "collapse_repeated_punctuation": c("once") != c("plain"),
        "collapse_whitespace": c("spaced") != c("once"),
        "trim_and_lowercase": c("norm") != c("spaced"),
    }
    named = F.array_compact(F.array(*(F.when(is_, F.lit(name)) for name, is_ in changed.items())))
    return df.withColumns({steps: named, norm: c("norm")}).drop(*(f"_{x}" for x in ("text", "bare", "links", "plain", "once", "spaced", "norm")))


def fold_latin() -> tuple[str, str]:
    """Letters with marks of the Latin blocks and the letters they are made of, by their canonical decomposition."""
    marked = [chr(i) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def index_tokens(c: Column) -> Column:
    """Tokens of the lexical index: lower case, Latin letters without marks, runs of letters and digits ("_" separates)."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), *fold_latin())
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def truncate(c: Column, limit: int) -> Column:
    """The first limit characters with a note that more followed."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...[truncated]"))).otherwise(c)


def compact(c: Column, limit: int) -> Column:
    """One line of at most limit characters, cut with an ellipsis."""
    line = one_line(F.coalesce(c, F.lit("")))
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 3)), F.lit("..."))).otherwise(line)


def mojibake(df: DataFrame, column: str) -> DataFrame:
    """UTF-8 that was read as Latin-1 read anew, where the text shows its marks and the bytes allow it."""

    def repair(texts: pa.Array) -> pa.Array:
        def one(t):
            if t is None:
                return t
            try:
                return t.encode("latin-1").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return t

        return pa.array(map(one, texts.to_pylist()), texts.type)

    marked = F.coalesce(F.col(column), F.lit("")).rlike("[ØÙ]")
    return df.filter(~marked).unionByName(df.filter(marked).withColumn(column, F.arrow_udf(repair, T.StringType())(F.col(column))))
