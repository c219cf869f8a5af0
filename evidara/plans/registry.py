"""Registration of the catalogue's queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.stages import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose columns go through many patterns: spread over the cores if it is a file or two."""
    return spread(table(spark, sf_dir, name))


# Building blocks of the SQL side, written for DuckDB's functions and RE2 patterns.
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def s_line(c: str) -> str:
    return f"trim({_sub(c, _SPACE, ' ')})"


def _links(c: str) -> str:
    c = _sub(c, r"(?i)https?://\S+|www\.\S+", " ")
    return _sub(c, r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+\b", " ")


def s_clean(c: str) -> str:
    return s_line(_sub(_links(f"replace(coalesce({c}, ''), chr(65279), '')"), r"\x{0640}+"))


def _arabic(c: str) -> str:
    return f"translate({c}, 'أإآٱىئؤة', 'ااااييوه')"


def _digits(c: str) -> str:
    return f"translate({c}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


_MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"


def s_dedupe(c: str) -> str:
    c = _arabic(_sub(_digits(s_clean(c)), _MARKS))
    return f"lower({s_line(_sub(c, r'[^\p{L}\p{N}_\x{0600}-\x{06FF}]+', ' '))})"


def s_match(c: str) -> str:
    c = _sub(_sub(_digits(_links(f"coalesce({c}, '')")), r"\x{0640}+"), _MARKS)
    c = f"translate({_arabic(c)}, '؟،؛“”‘’', '?,;\"\"''''')"
    for mark in "!?؟،,.;:":
        c = _sub(c, rf"\{mark}" + "{2,}" if mark in "?." else mark + "{2,}", mark)
    return f"lower({s_line(c)})"


def s_letters(c: str) -> str:
    return f"lower({s_line(_arabic(_sub(_sub(f'coalesce({c}, {chr(39) * 2})', r'\x{0640}+'), _MARKS)))})"


_TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"


def s_tokens(norm: str) -> str:
    return f"regexp_extract_all({norm}, '{_TOKEN}')"


def s_index_tokens(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def s_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


QA_PAIRS = """qa AS (
    SELECT u.conv_id * 1000 + u.turn AS qa_id, u.conv_id, u.text AS question, a.text AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user')"""
