"""Repair of conversations by signature deduplication.

Rows of a conversation are numbered by turn (nulls first), role and text. Each
row becomes one hexadecimal digit, its role's initial and its first fault; a run of
`chunk` rows is a signature. Many conversations share one, so each distinct
signature is solved once: a memoised recursion over (row, state) gives the cheapest
edits to a sequence of role initials of the form (s?(ua)+)?, of equally cheap ones
those whose letters come first. The answers are joined back to their conversations,
sorted in before the rows that they edit, and replayed row by row.

A conversation longer than a chunk is solved in parts. A signature's table of costs
from every state to every state does not depend on what is around it; chained from
the end of the conversation they give what is left to pay after each chunk, and
with that, chained from its start, each chunk's edits. So a task holds one row in
`chunk` of a conversation, as sixteen numbers, and never its texts; these stream
through the sort. Only the digest needs them in one order, which SHA-256 asks for.

Copies of a row are told by role and a SHA-256 of the text. Nulls in role and text
are one space; rows with a null id are one conversation, rows with a null turn come
first. Repeated rows are duplicates. A conversation without rows has zeros, no
edits and the digest of the empty string. An empty table gives an empty result.
Other columns have no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Where the next role leads; None: nowhere.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_OPEN = "uuau"
#: What is left to pay at the end: the turns that are missing.
END = (0, 2 * INSERT, INSERT, 0)
_NEVER = 1 << 40
_ROLES = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with every twentieth row dropped, emptied, stripped of stops, repeated or given to the user, by the CRC-32 of `conv_id:turn`.

    A dropped row stays with `there` false, so that its conversation is known.
    """
    d = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = d.withColumn("fate", F.crc32(key.cast("binary")) % 20)
    d = d.withColumn("role", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")))
    d = d.withColumn("text", F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return d.select("conv_id", "turn", "role", "text", (F.col("fate") != 0).alias("there"), twice).drop("copy")


def _symbol(duplicate: Column) -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(WORD), 1).when(duplicate, 2).when(~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    return F.lower(F.hex(role * 4 + fault))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows that are there with their place `at` from 0 in the conversation and their `symbol`: one exchange by conversation, two sorts."""
    d = rows.filter("there").drop("there")
    order = [F.asc_nulls_first("turn"), "role", "text"]
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)
    # Copies lie side by side in this order; the first by place is the original.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("at"))
    return d.withColumn("earlier", earlier).withColumn("symbol", _symbol(F.col("earlier") > 1)).drop("earlier")


def _row(symbol: str) -> tuple[str, bool, int]:
    """Initial, whether it has to go, and what it costs if it stays."""
    value = int(symbol, 16)
    return "sua-"[value >> 2], value & 3 in (1, 2), TRUNCATED if value & 3 == 3 else 0


def _choices(symbol: str, state: int) -> Iterator[tuple[str, str, int, int, bool]]:
    """(audit letter, operation, cost, next state, row used) in the order of the letters."""
    initial, lost, extra = _row(symbol)
    yield "D", "D", DELETE, state, True
    yield "I", _OPEN[state], INSERT, _NEXT[state][_OPEN[state]], False
    if not lost:
        if initial in _NEXT[state]:
            yield "K", "K", KEEP + extra, _NEXT[state][initial], True
        yield "R", _OPEN[state].upper(), REROLE + extra, _NEXT[state][_OPEN[state]], True


def _solver(signature: str, end: tuple[int, ...]):
    """least(row, state, inserts left): what the rest costs. More than two inserts before a row come back to a state that was there."""

    @cache
    def least(i: int, state: int, inserts: int = 2) -> int:
        if i == len(signature):
            return end[state]
        return min(cost + (least(i + 1, to) if used else least(i, to, inserts - 1)) for _, _, cost, to, used in _choices(signature[i], state) if used or inserts)

    for i in range(len(signature), -1, -1):  # from the end, so that no call goes deep
        for state in range(4):
            least(i, state)
    return least


def costs(signature: str) -> list[int]:
    """What a signature costs from each state to each state, inserts at its end left out."""
    out = [[0] * 4 for _ in range(4)]
    for last in range(4):
        least = _solver(signature, tuple(0 if s == last else _NEVER for s in range(4)))
        for first in range(4):
            out[first][last] = min(least(0, first), _NEVER)
    return [x for row in out for x in row]


def edits(signature: str, first: int, end: tuple[int, ...]) -> tuple[list[str], int]:
    """The operations for each row, and the state after them: u, a: insert that role; K: keep; U, A: give that role; D: delete."""
    least = _solver(signature, end)
    out, state = [], first
    for i, symbol in enumerate(signature):
        ops, inserts, used = "", 2, False
        while not used:
            left = least(i, state, inserts)
            for _, op, cost, to, used in _choices(symbol, state):
                if (used or inserts) and cost + (least(i + 1, to) if used else least(i, to, inserts - 1)) == left:
                    break
            ops, state, inserts = ops + op, to, inserts - (not used)
        out.append(ops)
    return out, state


def tail(state: int) -> str:
    """The inserts after the last row."""
    return ("", "ua", "a", "")[state]


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, first, end) with `ops`, `last`: each asked case is solved once, in its own row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [edits(s, int(f), tuple(int(v) for v in e)) for s, f, e in zip(b["signature"], b["first"], b["end"])]
            yield b.assign(ops=[x[0] for x in found], last=[x[1] for x in found])

    return signatures.select("signature", "first", "end").mapInPandas(run, "signature string, first int, end array<long>, ops array<string>, last int")


def _chained(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, signature, end) for conversations of several chunks: what is left to pay after each of them."""

    def priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(costs=[costs(s) for s in b["signature"]])

    def after(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        ends, left = [], list(END)
        for table in pdf["costs"].iloc[::-1]:
            # Only differences count; without the common part, equal cases have equal rows.
            least = min(left)
            left = [v - least for v in left]
            ends.append(left)
            left = [min(int(table[4 * a + b]) + left[b] for b in range(4)) for a in range(4)]
        return pdf.assign(end=ends[::-1])[["conv", "chunk", "signature", "end"]]

    tables = chunks.select("signature").distinct().mapInPandas(priced, "signature string, costs array<long>")
    return chunks.select("conv", "chunk", "signature").join(tables, "signature").groupBy("conv").applyInPandas(after, "conv string, chunk long, signature string, end array<long>")


def _started(ends: DataFrame) -> DataFrame:
    """(conv, chunk, signature, end, first): the state in which each chunk begins, chained from the start."""

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        firsts, state = [], 0
        for lasts in pdf["lasts"]:
            firsts.append(state)
            state = int(lasts[state])
        return pdf.assign(first=firsts)[["conv", "chunk", "signature", "end", "first"]]

    cases = ends.select("signature", "end").distinct().withColumn("first", F.explode(F.array(*[F.lit(s) for s in range(4)])))
    lasts = solved(cases).groupBy("signature", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda x: x["last"]).alias("lasts"))
    return ends.join(lasts, ["signature", "end"]).groupBy("conv").applyInPandas(before, "conv string, chunk long, signature string, end array<long>, first int")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, ops, final) of every chunk of the numbered `rows`; `final` is true for a conversation's last."""
    spark = rows.sparkSession
    parts = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("s"))
    # A key that is never null, so that rows without an id join and group like others.
    parts = parts.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "chunk", F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias("signature"))
    parts = written(spark, parts, "signatures")
    many = parts.filter("chunk > 0").select("conv", "chunk").groupBy("conv").agg(F.max("chunk").alias("most"))
    few = F.array(*[F.lit(v).cast("long") for v in END])
    long = _started(_chained(parts.join(many, "conv", "left_semi")))
    short = parts.join(many, "conv", "left_anti").select("conv", "chunk", "signature", few.alias("end"), F.lit(0).alias("first"))
    every = written(spark, short.unionByName(long), "cases")
    answers = written(spark, solved(every.select("signature", "first", "end").distinct()), "answers")
    out = every.join(answers, ["signature", "first", "end"]).join(many, "conv", "left")
    return out.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "chunk", "ops", "last", (F.col("chunk") == F.coalesce("most", F.lit(0))).alias("final"))


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Replay:
    """What a conversation has come to so far; rows and answers arrive in order."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.illegal, self.cost, self.audit = conv_id, [0] * 4, 0, 0, []
        self.turns, self.first, self.turn, self.before, self.hash, self.lines = 0, None, None, None, hashlib.sha256(), 0
        self.ops: list[str] = []
        self.base = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserted(self, ops: str) -> None:
        for op in ops:
            self.line(_ROLES[op], "")
            self.audit.append("I")
            self.cost += INSERT

    def row(self, at: int, turn: int | None, role: str, text: str, symbol: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn
        self.faults[int(symbol, 16) & 3] += 1
        initial, _, extra = _row(symbol)
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        ops = self.ops[at - self.base]
        self.inserted(ops[:-1])
        op = ops[-1]
        self.audit.append(op if op in "DK" else "R")
        if op == "D":
            self.cost += DELETE
            return
        self.cost += extra + (KEEP if op == "K" else REROLE)
        self.line(role if op == "K" else _ROLES[op.lower()], text)

    def result(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def replayed(rows: DataFrame, answers: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of `ids`: its answers replayed over its rows, which come in order through one sort."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")])
    nothing = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    marks = ids.select("conv_id", F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("at"), *nothing("long", "turn"), *nothing("string", "role", "text", "symbol"), *nothing("array<string>", "ops"), *nothing("int", "last"))
    last = F.when(F.col("final"), F.col("last"))
    told = answers.select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), *nothing("long", "turn"), *nothing("string", "role", "text", "symbol"), "ops", last.alias("last"))
    lines = rows.select("conv_id", "chunk", F.col("at").cast("long").alias("at"), "turn", "role", "text", "symbol", *nothing("array<string>", "ops"), *nothing("int", "last"))
    d = marks.unionByName(told).unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Replay | None = None
        end: str = ""
        done: list[dict] = []
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            for k in range(b.num_rows):
                conv_id, chunk, at, turn, role, text, symbol, ops, last = (c[k].as_py() for c in columns)
                if chunk < 0:
                    if now is not None:
                        now.inserted(end)
                        done.append(now.result())
                    now, end = _Replay(conv_id), ""
                elif at < 0:
                    now.ops, now.base = ops, None
                    end = "" if last is None else tail(last)
                else:
                    now.base = at if now.base is None else now.base
                    now.row(at, turn, role, text, symbol)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            now.inserted(end)
            yield pa.RecordBatch.from_pylist([now.result()], schema=schema)

    return d.mapInArrow(run, _RESULT)


def repair(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of each conversation of `rows` (conv_id, turn, role, text, there)."""
    spark = rows.sparkSession
    own = written(spark, numbered(rows).withColumn("chunk", F.floor(F.col("at") / chunk).cast("long")), "turns")
    return replayed(own, audits(own), rows.select("conv_id").distinct())


def oracle_sql() -> str:
    """Damage, faults and repair of `conversations` in DuckDB SQL: the rows are taken from the end, with the best rest for each state."""
    return r"""
WITH RECURSIVE
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i))),
raw AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
fated AS (
  SELECT raw.*, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM raw, crc),
d AS (
  SELECT k, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, LATERAL (SELECT unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END))) WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS ini,
    CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*\z') THEN 't' ELSE '' END AS fault
  FROM n),
e AS (SELECT *, lag(ini) OVER (PARTITION BY k ORDER BY pos) || ini AS pair, count(*) OVER (PARTITION BY k) AS size FROM f),
sums AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY k),
pre(s, mid, ins, said) AS (VALUES
  (0, 0, '', CAST([] AS VARCHAR[])), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
  (1, 1, '', CAST([] AS VARCHAR[])), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', CAST([] AS VARCHAR[])), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']),
  (3, 3, '', CAST([] AS VARCHAR[])), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
act(mid, letter, ini, dest, pay, given) AS (VALUES
  (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL),
  (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL),
  (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 2, 3, 'user')),
fin(s, cost, audit, said) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', CAST([] AS VARCHAR[]))),
best AS (
  SELECT k, size AS pos, s, {'cost': CAST(cost AS BIGINT), 'audit': audit, 'said': said} AS b FROM (SELECT DISTINCT k, size FROM e), fin
  UNION ALL
  SELECT x.k, x.pos - 1, pre.s, min({
      'cost': b.cost + 3 * len(pre.ins) + act.pay + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END,
      'audit': pre.ins || letter || b.audit,
      'said': list_concat(list_concat(pre.said, CASE WHEN letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(given, role) || ':' || text] END), b.said)})
  FROM best x JOIN e ON e.k = x.k AND e.pos = x.pos
    JOIN act ON act.dest = x.s AND (act.ini IS NULL OR act.ini = e.ini) AND (letter = 'D' OR fault NOT IN ('b', 'd'))
    JOIN pre ON pre.mid = act.mid
  GROUP BY x.k, x.pos, pre.s)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM raw) AS ids LEFT JOIN sums USING (k) LEFT JOIN best ON best.k = ids.k AND best.pos = 0 AND best.s = 0
"""
