"""Repair of the turn structure of conversations by a lazily determinised weighted automaton.

A repaired conversation is nothing, or an optional system turn and then one or more pairs of a user and an assistant turn. Keeping a turn costs 0, giving it another role 1, deleting it 2, inserting an empty turn 5; blank and
repeated turns must go, and a truncated turn that stays costs 5 more. What is left to pay from each of the four states of the target is a vector of costs; less its smallest entry it is one of few vectors, and
these are the states of a deterministic automaton that is made as it is met: its transition table gives the next vector and what the step adds. The table scan runs from a conversation's last turn to its first.
The trace runs back through the scan, that is from the first turn on, along tight arcs (a step's cost plus what is left behind it equals what is left in front of it). A path's initials determine it, so taking the ASCII-least
tight arc at each step gives the least audit of all cheapest ones.

Conversations of any length: turns are numbered by a range-partitioned sort, in parts of PART_TURNS. Each part is scanned from four unit vectors, which gives its costs between any two states; these are folded along a conversation as a stream,
each part is scanned and traced again from what is left behind it, for each state that it may begin in, and the pieces that follow on one another are picked as a stream. Texts are read in a task's stream only, where a
conversation's digest is taken: SHA-256 runs over a text from its first to its last byte, so that one step goes through a long conversation in one task, with no memory for it.

Defined cases: a null conv_id, turn, role or text counts as one space in the key of the damage, and a null role or text is one space after it; rows without conv_id form one conversation (null); turns of equal number stand by role and then by SHA-256 of the
text, rows that repeat stay as repeated turns; the role's first character is its initial; an empty conversation and one that damage empties have zeros, an empty audit and the digest of the empty text; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut

PART_TURNS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
# States of the target: nothing yet, after a system turn, after a user turn, after an assistant turn; the first and last may end a conversation.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (EMPTY, ASSISTANT)
_FAR = 1 << 40
#: The turn that may be inserted, or given as a role, in each state, and where it leads.
_NEXT = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Where a kept turn leads by its initial.
_KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GONE = "x"


def damage(turns: DataFrame) -> DataFrame:
    """conv (a null id as one space), turn, role, text, copy: the rows after the damage that the crc32 of "conv_id:turn" modulo 20 chooses."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumn("conv", blank("conv_id")).withColumn("fate", F.crc32(F.concat("conv", F.lit(":"), blank("turn")).cast("binary")) % 20)
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(fate != 0).select("conv", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _placed(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, mark, place: each row's place in its conversation, from 0; materialised."""
    order = ["conv", F.asc_nulls_first("turn"), "role", "mark", "copy"]
    marked = rows.withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    ranged = cut(marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy").withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = ranged.groupBy("conv", task.alias("task")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("conv").alias("of"), "task", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    joined = ranged.join(base, (F.col("conv") == F.col("of")) & (task == F.col("task")))
    return joined.select("conv", "turn", "role", "text", "mark", (F.col("at") + F.col("shift")).alias("place"))


def _judged(placed: DataFrame) -> DataFrame:
    """conv, place, turn, initial (s, u, a or o), fault, letter: GONE for turns that must go, a capital initial for truncated ones."""
    first = placed.groupBy("conv", "role", "mark").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    ended = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    fault = F.when(ended == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    found = placed.join(first, ["conv", "place"], "left").select("conv", "place", "turn", initial.alias("initial"), fault.alias("fault"))
    return found.withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))


class CostAutomaton:
    """Normalised vectors of what is left to pay, as states, and the table of steps between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.traces: dict[tuple[int, str, int], tuple[str, str, int]] = {}

    @staticmethod
    def _with_inserts(left: list[int]) -> list[int]:
        """What is left if turns may be inserted first."""
        left = [min(x, _FAR) for x in left]
        left[ASSISTANT] = min(left[ASSISTANT], INSERT + left[USER])
        left[USER] = min(left[USER], INSERT + left[ASSISTANT])
        for q in (EMPTY, SYSTEM, ASSISTANT):
            left[q] = min(left[q], INSERT + left[USER])
        return left

    def state(self, left: list[int]) -> tuple[int, int]:
        """The state of a vector, and what was taken off its entries."""
        least = min(left)
        vector = tuple(_FAR if x >= _FAR else x - least for x in left)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def begin(self, left: list[int]) -> tuple[int, int]:
        return self.state(self._with_inserts(left))

    @staticmethod
    def arcs(q: int, letter: str) -> list[tuple[str, int, int]]:
        """(initial, cost, state behind it) of the edits of a turn."""
        out = [("D", DELETE, q)]
        if letter != GONE:
            extra = TRUNCATED if letter.isupper() else 0
            if (q, letter.lower()) in _KEPT:
                out.append(("K", extra, _KEPT[q, letter.lower()]))
            out.append(("R", REROLE + extra, _NEXT[q][1]))
        return out

    def step(self, behind: int, letter: str) -> tuple[int, int]:
        """From the state behind a turn to the one in front of it, and what that adds."""
        found = self.table.get((behind, letter))
        if found is None:
            left = self.vectors[behind]
            found = self.table[behind, letter] = self.state(self._with_inserts([min(c + left[to] for _, c, to in self.arcs(q, letter)) for q in range(4)]))
        return found

    def scan(self, letters: str, left: list[int]) -> tuple[list[int], int]:
        """The states from behind the last turn to in front of the first, and all that was taken off."""
        state, total = self.begin(left)
        states = [state]
        for letter in reversed(letters):
            state, more = self.step(state, letter)
            states.append(state)
            total += more
        return states, total

    def _trace(self, behind: int, letter: str, q: int) -> tuple[str, str, int]:
        """The least tight initials up to and with a turn's own edit, the roles that they put (of a kept turn: k), and the state behind."""
        front, more = self.step(behind, letter)
        here, left = self.vectors[front], self.vectors[behind]
        audit, roles = "", ""
        while True:
            tight = [(i, to) for i, c, to in self.arcs(q, letter) if here[q] + more == c + left[to]]
            role, to = _NEXT[q]
            if here[q] == INSERT + here[to]:
                tight.append(("I", to))
            initial, to = min(tight)
            audit += initial
            roles += {"D": "", "K": "k", "R": role[0], "I": role[0]}[initial]
            q = to
            if initial != "I":
                return audit, roles, q

    def trace(self, letters: str, states: list[int], q: int, last: bool) -> tuple[str, list[tuple[int, str]], int]:
        """The audit from state q on, (place or -1, role: u, a or, kept, k) of each turn that it leaves, and the state behind the last turn."""
        audit, lines = [], []
        for place, letter in enumerate(letters):
            key = (states[len(letters) - place - 1], letter, q)
            if key not in self.traces:
                self.traces[key] = self._trace(*key)
            piece, roles, q = self.traces[key]
            audit.append(piece)
            stays = piece[-1] != "D"
            lines += [(-1, r) for r in (roles[:-1] if stays else roles)]
            if stays:
                lines.append((place, roles[-1]))
        while last and q not in FINAL:  # at the end only insertions are left
            role, q = _NEXT[q]
            audit.append("I")
            lines.append((-1, role[0]))
        return "".join(audit), lines, q


_END = [0 if q in FINAL else _FAR for q in range(4)]


def _repaired(parts: DataFrame) -> DataFrame:
    """conv, part, cost (in the first part), audit, lines (seq, place, role): parts has conv, part, letters."""

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = CostAutomaton()
        for batch in batches:
            costs = []
            for letters in batch.column("letters").to_pylist():
                columns = []
                for end in range(4):
                    states, total = machine.scan(letters, [0 if q == end else _FAR for q in range(4)])
                    columns.append([min(x + total, _FAR) for x in machine.vectors[states[-1]]])
                costs.append([columns[end][q] for q in range(4) for end in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(costs, pa.list_(pa.int64()))], ["conv", "part", "costs"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, left = None, _END  # rows come by conversation, the last part first
        for batch in batches:
            out = []
            for c, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
                last = c != conv
                if last:
                    conv, left = c, _END
                behind, left = left, [min(min(costs[4 * q + r] + left[r] for r in range(4)), _FAR) for q in range(4)]
                out.append((behind, last, left[EMPTY]))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), *map(pa.array, columns, (pa.list_(pa.int64()), pa.bool_(), pa.int64()))], ["conv", "part", "behind", "last", "cost"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = CostAutomaton()
        kind = pa.list_(pa.struct([("seq", pa.int32()), ("place", pa.int32()), ("role", pa.string())]))
        for batch in batches:
            for conv, part, letters, behind, last, cost in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "letters", "behind", "last", "cost"))):
                states, _ = machine.scan(letters, behind)
                reach = [EMPTY] if part == 0 else [q for q in range(4) if machine.vectors[states[-1]][q] < _FAR]
                found = [(q, *machine.trace(letters, states, q, last)) for q in reach]
                lines = [[{"seq": i, "place": p, "role": r} for i, (p, r) in enumerate(x[2])] for x in found]
                n = len(found)
                columns = [[conv] * n, [part] * n, [x[0] for x in found], [x[3] for x in found], [cost] * n, [x[1] for x in found]]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(lines, kind)], ["conv", "part", "q", "next", "cost", "audit", "lines"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, q, after = None, -1, EMPTY, EMPTY  # rows come by conversation and part
        for batch in batches:
            keep = []
            for c, p, begin, end in zip(*(batch.column(k).to_pylist() for k in ("conv", "part", "q", "next"))):
                if c != conv:
                    conv, part, after = c, -1, EMPTY
                if p != part:
                    part, q = p, after
                keep.append(begin == q)
                after = end if begin == q else after
            yield batch.filter(pa.array(keep, pa.bool_()))

    matrices = parts.select("conv", "part", "letters").mapInArrow(between, "conv string, part long, costs array<long>")
    behind = matrices.repartition("conv").sortWithinPartitions("conv", F.desc("part")).mapInArrow(fold, "conv string, part long, behind array<long>, last boolean, cost long")
    schema = "conv string, part long, q int, next int, cost long, audit string, lines array<struct<seq: int, place: int, role: string>>"
    traced = parts.select("conv", "part", "letters").join(behind, ["conv", "part"]).mapInArrow(trace, schema)
    return cut(traced.repartition("conv").sortWithinPartitions("conv", "part", "q").mapInArrow(pick, schema).select("conv", "part", F.when(F.col("part") == 0, F.col("cost")).alias("cost"), "audit", "lines"))


def _digests(lines: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of lines (conv, part, seq, line), a stream for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
                if c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], ["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "line").mapInArrow(run, "conv string, repaired_sha256 string")


def repaired_turns(placed: DataFrame, pieces: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv, part, seq, role, text: the turns that the repair leaves, in the order of (part, seq)."""
    left = pieces.select("conv", "part", F.explode("lines").alias("x")).select("conv", "part", "x.seq", F.when(F.col("x.place") >= 0, F.col("part") * part_turns + F.col("x.place")).alias("place"), F.col("x.role").alias("put"))
    role = F.when(F.col("put") == "u", "user").when(F.col("put") == "a", "assistant")
    put = left.filter("place IS NULL").select("conv", "part", "seq", role.alias("role"), F.lit("").alias("text"))
    stay = placed.select("conv", "place", "role", "text").join(left.filter("place IS NOT NULL").select("conv", "place", "part", "seq", role.alias("other")), ["conv", "place"])
    return stay.select("conv", "part", "seq", F.coalesce("other", "role").alias("role"), "text").unionByName(put)


def repair(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of turns (conv_id, turn, role, text) after damage()."""
    placed = _placed(damage(turns))
    judged = _judged(placed)
    one = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    listed = F.array_sort(F.collect_list(F.struct("place", "letter", "initial")))
    parts = judged.groupBy("conv", F.expr(f"place div {int(part_turns)}").alias("part")).agg(listed.alias("x"), *map(one, ("blank", "duplicate", "truncated")))
    joined = lambda field: F.array_join(F.transform("x", lambda t: t[field]), "")
    parts = cut(parts.select("conv", "part", joined("letter").alias("letters"), joined("initial").alias("initials"), "blank", "duplicate", "truncated"))
    # pairs within a part, and with the last turn of the part before
    before = F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("conv").orderBy("part"))
    run = parts.select("conv", "blank", "duplicate", "truncated", F.concat(F.coalesce(before, F.lit("")), "initials").alias("i"))
    illegal = F.expr("size(filter(sequence(1, length(i)), k -> k > 1 AND substr(i, k - 1, 2) NOT IN ('su', 'ua', 'au')))")
    sums = run.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(illegal).alias("illegal"))
    numbers = placed.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    pieces = _repaired(parts)
    audits = pieces.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    lines = repaired_turns(placed, pieces, part_turns).select("conv", "part", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    every = turns.select(F.col("conv_id").cast("long")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(sums, "conv", "left").join(numbers, "conv", "left").join(audits, "conv", "left").join(_digests(lines), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


#: What op13_turn_repair returns, for DuckDB: cheapest (cost, audit, repaired text) of each state, turn by turn.
SQL = r"""
WITH RECURSIVE bits AS (
    SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
    FROM conversations),
fated AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 AS fate FROM keyed, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM fated WHERE fate <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place, left(role, 1) AS initial,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
    FROM damaged),
judged AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair,
        CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
path AS (
    SELECT conv_id, n, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': '', 'o': ''} AS e, {'c': 1000000000::BIGINT, 'a': '', 'o': ''} AS s,
        {'c': 5::BIGINT, 'a': 'I', 'o': chr(10) || 'user:'} AS u, {'c': 10::BIGINT, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
    FROM sums
    UNION ALL
    SELECT conv_id, n, place, e, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'}]) FROM (
        SELECT conv_id, n, place, e, s, a, list_min([u, {'c': e.c + 5, 'a': e.a || 'I', 'o': e.o || put}, {'c': s.c + 5, 'a': s.a || 'I', 'o': s.o || put}, {'c': a.c + 5, 'a': a.a || 'I', 'o': a.o || put}]) AS u FROM (
            SELECT p.conv_id, p.n, x.place, chr(10) || 'user:' AS put, {'c': e.c + 2, 'a': e.a || 'D', 'o': e.o} AS e,
                list_min([{'c': s.c + 2, 'a': s.a || 'D', 'o': s.o}, {'c': e.c + x.kept_s, 'a': e.a || 'K', 'o': e.o || x.own}]) AS s,
                list_min([{'c': u.c + 2, 'a': u.a || 'D', 'o': u.o}]
                    || list_transform([e, s, a], lambda q: {'c': q.c + x.kept_u, 'a': q.a || 'K', 'o': q.o || x.own})
                    || list_transform([e, s, a], lambda q: {'c': q.c + x.other, 'a': q.a || 'R', 'o': q.o || x.as_user})) AS u,
                list_min([{'c': a.c + 2, 'a': a.a || 'D', 'o': a.o}, {'c': u.c + x.kept_a, 'a': u.a || 'K', 'o': u.o || x.own}, {'c': u.c + x.other, 'a': u.a || 'R', 'o': u.o || x.as_assistant}]) AS a
            FROM path p JOIN (
                SELECT conv_id, place, chr(10) || role || ':' || text AS own, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant,
                    CASE fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END AS add, add + 1 AS other,
                    add + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS kept_s, add + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END AS kept_u, add + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END AS kept_a
                FROM judged) x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.place = p.place + 1))),
ends AS (SELECT conv_id, list_min([e, a]) AS best FROM path WHERE place = n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
