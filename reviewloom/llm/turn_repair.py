"""Conversation structure repair: faults of turns, the cheapest edits to the alternating grammar, repaired turns.

Turns of a conversation follow their number, nulls first; turns of one number follow their role and then the SHA-256 of
their text, so that equal turns are neighbours. They are numbered by a sort over all rows, not by conversation, and
cut into segments of at most SEGMENT turns. A segment is aligned in one task (see `turn_align`); neighbouring segments
are joined FAN at a time, so no task holds the turns of a long conversation. The audits then meet the texts: the turns
of a conversation pass through one task in order, one at a time, as a stream. A task holds a batch of turns and the
audit (one letter a turn), which is a value of the result; a digest over a conversation can only be made in order.

Defined results: nulls in role and text count as one space; a null conversation is one of its own, apart from an empty
one; null turns come first and don't count for gaps; repeated rows are duplicates; a blank turn is never a duplicate;
texts of any length are read whole; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import turn_align
from reviewloom.llm.common import query, slices, table
from reviewloom.llm.turn_align import ASSISTANT, FINAL, GONE, START, SYSTEM, USER
from reviewloom.operators.ordering import group_index
from reviewloom.runtime import durable, spread

SEGMENT = 256
FAN = 64
PLACES = (START, SYSTEM, USER, ASSISTANT)

# Blank characters, and characters that end a sentence.
BLANK = " \t\n\x0b\x0c\r"
STOPS = ".!?"

STATE = ("first_turn long, last_turn long, turns long, first_role string, last_role string, illegal long, blank long, "
         "duplicate long, truncated long, cells array<struct<entry:int,exit:int,cost:long,audit:string>>")
STATE_ARROW = pa.schema([
    ("c", pa.string()), ("segment", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("illegal", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("cells", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()),
                                  ("audit", pa.string())])))])
LEGAL = {"su", "ua", "au"}


def _key(conv_id: str) -> Column:
    """A text that tells conversations apart, the null one too."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """The four columns under plain names, with a key of the conversation."""
    space = F.lit(" ")
    return spread(df.select(conv_id, turn, role, text)).select(
        _key(conv_id).alias("c"), F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns without their texts: key, number in the conversation, role, faults."""
    shown = F.rtrim("text", F.lit(BLANK))
    rows = turns.select("c", "turn", "role", F.sha2("text", 256).alias("digest"), (shown == "").alias("blank"),
                        (~F.right(shown, F.lit(1)).isin(*STOPS)).alias("truncated"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    rows = durable(group_index(rows, "c", order, "at"))
    same = ["c", "role", "digest"]
    first = (rows.where("NOT blank").groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("copies"))
             .where("copies > 1").drop("copies"))
    repeated = (F.col("at") > F.col("first")) & ~F.col("blank")
    return rows.join(first, same, "left").withColumn("duplicate", F.coalesce(repeated, F.lit(False)))


def _segment_state(c: str, segment: int, rows: list[dict], only: bool) -> dict:
    """What is to be known of a segment: its edges, its faults and its cheapest audits."""
    letters = []
    for r in rows:
        letter = r["role"] if r["role"] in ("s", "u", "a") else "x"
        gone = r["blank"] or r["duplicate"]
        letters.append(GONE if gone else letter.upper() if r["truncated"] else letter)
    pairs = [a["role"] + b["role"] for a, b in zip(rows, rows[1:])]
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    found = turn_align.align("".join(letters), (START,) if only else PLACES, FINAL if only else PLACES)
    return {
        "c": c, "segment": segment, "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None),
        "turns": len(set(numbers)), "first_role": rows[0]["role"], "last_role": rows[-1]["role"],
        "illegal": sum(p not in LEGAL for p in pairs), "blank": sum(r["blank"] for r in rows),
        "duplicate": sum(r["duplicate"] and not r["blank"] for r in rows),
        "truncated": sum(r["truncated"] and not r["blank"] and not r["duplicate"] for r in rows),
        "cells": _cells(found)}


def _cells(best: turn_align.Best) -> list[dict]:
    return [{"entry": a, "exit": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in best.items()]


def _best(state: dict) -> turn_align.Best:
    return {(x["entry"], x["exit"]): (x["cost"], x["audit"]) for x in state["cells"]}


def _joined(a: dict, b: dict) -> dict:
    """State of two neighbouring segments as one."""
    out = {k: a[k] + b[k] for k in ("turns", "illegal", "blank", "duplicate", "truncated")}
    # The same turn number may end one segment and begin the next.
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    return out | {
        "c": a["c"], "segment": a["segment"], "first_role": a["first_role"], "last_role": b["last_role"],
        "first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"],
        "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"],
        "cells": _cells(turn_align.join(_best(a), _best(b)))}


def _align_segments(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_pylist(
            [_segment_state(r["c"], r["segment"], r["rows"], r["only"]) for r in batch.to_pylist()], STATE_ARROW)


def _join_segments(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 8):
        out = []
        for r in batch.to_pylist():
            state, *rest = ({"c": r["c"], **s} for s in r["states"])
            for s in rest:
                state = _joined(state, s)
            out.append(state | {"segment": r["segment"]})
        yield pa.RecordBatch.from_pylist(out, STATE_ARROW)


def audits(turns: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per conversation of `turns_of`: c, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = _numbered(turns).withColumn("segment", F.floor(F.col("at") / segment))
    one = F.struct("at", "turn", F.left("role", F.lit(1)).alias("role"), "blank", "duplicate", "truncated")
    # At most `segment` rows each.
    grouped = rows.groupBy("c", "segment").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    lengths = rows.where(F.col("at") == segment).select("c", F.lit(False).alias("only"))
    grouped = grouped.join(lengths, "c", "left").withColumn("only", F.coalesce("only", F.lit(True)))
    schema = f"c string, segment long, {STATE}"
    states = durable(grouped.mapInArrow(_align_segments, schema))
    last = states.agg(F.max("segment").alias("n")).first()["n"] or 0
    while last:
        columns = [c for c in states.columns if c != "c"]
        merged = (states.groupBy("c", F.floor(F.col("segment") / fan).alias("at"))
                  .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("states")))
        states = durable(merged.select("c", F.col("at").alias("segment"), "states").mapInArrow(_join_segments, schema))
        last //= fan
    ends = F.filter("cells", lambda x: (x.entry == START) & x.exit.isin(*FINAL))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x.cost.alias("cost"), x.audit.alias("audit"))))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return states.select("c", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                         best.cost.alias("cost"), best.audit.alias("audit"))


LINE = pa.schema([("c", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                  ("text", pa.string())])


def _apply_audits(batches) -> Iterator[pa.RecordBatch]:
    """Turns after their edits. A row of kind 0 brings the audit of the conversation whose turns follow."""
    audit, at, place, shift = "", 0, 0, 0

    def role_at(k: int) -> str:
        return "assistant" if (k - shift) % 2 else "user"

    for batch in slices(batches):
        out = []
        for c, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind == 0:
                audit, at, place = text, 0, 0
                # A system turn makes the number of repaired turns odd.
                shift = (len(audit) - audit.count("D")) % 2
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append((c, place, edit, role if edit == "K" else role_at(place), text))
                    place += 1
            while at < len(audit) and audit[at] == "I":
                out.append((c, place, "I", role_at(place), ""))
                at, place = at + 1, place + 1
        columns = list(zip(*out)) if out else [[]] * len(LINE)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, LINE)], schema=LINE)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired turns (c, place, edit, role, text): kept, given another role, or inserted.

    Those of a conversation stand in one partition, in order.
    """
    rows = turns.select("c", F.lit(1).alias("kind"), "role", "text", "turn", F.sha2("text", 256).alias("digest"))
    heads = found.select("c", F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("audit").alias("text"),
                         F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"))
    both = heads.unionByName(rows).repartition("c")
    ordered = both.sortWithinPartitions("c", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("c", "kind", "role", "text").mapInArrow(
        _apply_audits, "c string, place long, edit string, role string, text string")


def _digest_lines(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines `role:text` of each conversation, whose rows are neighbours."""
    schema = pa.schema([("c", pa.string()), ("digest", pa.string())])
    c, state = None, None
    for batch in slices(batches):
        out = []
        for key, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if place == 0:
                if state is not None:
                    out.append({"c": c, "digest": state.hexdigest()})
                c, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"c": c, "digest": state.hexdigest()}], schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, drawn by the crc32 of conversation and turn."""
    space = F.lit(" ")
    drawn = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", "role", "text",
                                F.pmod(F.crc32(drawn.cast("binary")), F.lit(20)).alias("d")).where("d <> 0")
    d = F.col("d")
    text = F.when(d == 1, F.lit("")).when(d == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1)))
                                                     .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(conversations: DataFrame, broken: DataFrame) -> DataFrame:
    """A row per conversation of `conversations`: what was wrong with its turns in `broken`, the audit and the digest."""
    turns = turns_of(broken)
    found = durable(audits(turns))
    digests = repaired_turns(turns, found).mapInArrow(_digest_lines, "c string, digest string")
    every = turns_of(conversations).groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    rows = every.join(found, "c", "left").join(digests, "c", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The crc32 bit by bit, as the checking engine has none, and the repair as a walk over the turns.

    The walk keeps the least (cost, audit, repaired text) per place of the grammar.
    """
    def add(place: int, cost: str, edit: str, line: str = "''") -> str:
        x = f"x{place}"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {line}}}"

    def closed(source: str) -> str:
        user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
        return f"""SELECT * REPLACE (least(x2, {add(0, '3', 'I', user)}, {add(1, '3', 'I', user)},
            {add(3, '3', 'I', user)}) AS x2, least(x3, {add(2, '3', 'I', assistant)}) AS x3) FROM ({source})"""

    kept = "chr(10) || role || ':' || text"
    user, assistant = "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    may = "CASE WHEN gone THEN NULL WHEN {} THEN {} END"
    put = {
        0: [add(0, "4", "D")],
        1: [add(1, "4", "D"), may.format("ini = 's'", add(0, "extra", "K", kept))],
        2: [add(2, "4", "D"),
            *[may.format("ini = 'u'", add(p, "extra", "K", kept)) for p in (0, 1, 3)],
            *[may.format("TRUE", add(p, "3 + extra", "R", user)) for p in (0, 1, 3)]],
        3: [add(3, "4", "D"), may.format("ini = 'a'", add(2, "extra", "K", kept)),
            may.format("TRUE", add(2, "3 + extra", "R", assistant))],
    }
    step = ", ".join(f"least({', '.join(v)}) AS x{k}" if len(v) > 1 else f"{v[0]} AS x{k}" for k, v in put.items())
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    zero = "CAST({'c': 0, 'a': '', 't': ''} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return rf"""
WITH RECURSIVE d0 AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
             string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
             lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS d
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(coalesce(text, ' '), '.!?', '')
              ELSE coalesce(text, ' ') END AS text, unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d0 WHERE d <> 0),
r AS (
  SELECT *, left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS fin,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
f AS (
  SELECT *, fin = '' AS blank,
         fin <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM r),
g AS (
  SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND fin NOT IN ('.', '!', '?') AS trunc,
         CASE WHEN fin NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM f),
s AS (
  SELECT conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INT)) AS blank,
         sum(CAST(dup AS INT)) AS duplicate, sum(CAST(trunc AS INT)) AS truncated,
         sum(CASE WHEN prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM g GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS pos, {zero} AS x0, {none} AS x1, {none} AS x2, {none} AS x3 FROM s
  UNION ALL
  SELECT conv_id, pos, {step}
  FROM (SELECT y.* EXCLUDE (conv_id, pos), g.* FROM (
    {closed(closed("SELECT * FROM walk"))}) y
    JOIN g ON g.conv_id IS NOT DISTINCT FROM y.conv_id AND g.pos = y.pos + 1) q),
ended AS (
  SELECT w.conv_id, least(x0, x3) AS best FROM (
    {closed(closed("SELECT * FROM walk"))}) w
  JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_turn_repair", _sql())
def op12_turn_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))
