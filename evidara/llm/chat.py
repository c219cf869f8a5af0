"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation (each role that speaks, but for the system roles) the dialogue is rendered with that speaker as the assistant and the
others as named users; the mask lists the character spans [start, end) to train on: what the speaker says with its closing mark. Turns come
in the order of (turn, role, md5 of the text), nulls first. A dialogue of more than part_turns turns is rendered in consecutive parts of so many, each with
its own spans, so no row or group grows with a conversation: places in the order come from a range-partitioned sort and counts by partition.

Defined cases: a null text is empty, a null role is the name "unknown"; rows without conv_id form one conversation (null); rows that repeat stay as repeated
turns; a conversation where only system roles speak gives no rows; the marks' opening "<|" in texts and names is set apart as "< |"; white space and signs of markup in
names become "_"; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut

PART_TURNS = 256
SYSTEM_ROLES = ("system",)
_SEGMENT = """
transform(turns, t -> struct(
    concat('<|im_start|>', CASE WHEN t.role IN ({system}) THEN 'system' WHEN t.role = speaker THEN 'assistant' ELSE concat('user name=', translate(t.role, ' \\n\\t\\r<>|=', '________')) END, '\\n') AS head,
    t.text AS body,
    t.role = speaker AS own))
"""
_SPANS = """
aggregate(segments, struct(0 AS at, CAST(array() AS array<struct<start: int, end: int>>) AS spans), (s, x) -> struct(
    s.at + length(x.head) + length(x.body) + 11 AS at,
    CASE WHEN x.own THEN concat(s.spans, array(struct(s.at + length(x.head) AS start, s.at + length(x.head) + length(x.body) + 10 AS end))) ELSE s.spans END AS spans), s -> s.spans)
"""


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place: each turn's place in its conversation, from 0."""
    order = ["conv_id", "turn", "role", "mark", "tie"]
    sorted_ = cut(
        turns.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
            F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
            F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at"))
    )
    task = F.shiftright("at", 33)
    counts = sorted_.groupBy("conv_id", task.alias("task")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("conv_id").alias("of"), "task", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    joined = sorted_.join(base, F.col("conv_id").eqNullSafe(F.col("of")) & (task == F.col("task")))
    return joined.select("conv_id", "role", "text", (F.col("at") + F.col("shift")).alias("place"))


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, system_roles: tuple[str, ...] = SYSTEM_ROLES) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, spans (array of start and end) for each participant and part."""
    placed = _placed(turns)
    speakers = placed.filter(~F.col("role").isin(*system_roles)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    parts = placed.groupBy("conv_id", F.expr(f"place div {int(part_turns)}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    system = ", ".join("'" + r.replace("'", "''") + "'" for r in system_roles) or "''"
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("segments", F.expr(_SEGMENT.format(system=system)))
    return both.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").alias("n_turns"),
        F.expr("array_join(transform(segments, x -> concat(x.head, x.body, '<|im_end|>\\n')), '')").alias("text"),
        F.expr(_SPANS).alias("spans"),
    )


#: What op1_chat returns, for DuckDB: system role and part size as above.
SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), md5(coalesce(text, ''))) - 1 AS place
    FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
segments AS (
    SELECT t.conv_id, s.speaker, t.place // 256 AS part, t.place, t.role = s.speaker AS own, t.text AS body,
        '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.speaker THEN 'assistant' ELSE 'user name=' || translate(t.role, ' ' || chr(10) || chr(9) || chr(13) || '<>|=', '________') END || chr(10) AS head
    FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
spots AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, speaker, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
    FROM segments)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::BIGINT AS n_turns, string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
    coalesce(string_agg(start::BIGINT || '-' || (start + length(body) + 10)::BIGINT, ';' ORDER BY place) FILTER (WHERE own), '') AS spans
FROM spots GROUP BY conv_id, speaker, part
"""
