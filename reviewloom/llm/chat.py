"""Chat formatting by quotation linking.

Lines that start with `>` marks are quotations, nested as deep as they have
marks. Runs of lines of one level are passages. Passages are normalised (case,
punctuation and line breaks go) and hashed, whole, by line and by sentence, as
are the own text of every message, its paragraphs, lines and sentences. So short
quotations, sentences out of a line and text that was wrapped anew are found; a
part of a sentence is not. A quotation is linked to the last earlier message of
its conversation that holds the passage; the outermost level that finds one
names the message replied to, at that level the whole passage goes before its
lines and these before its sentences. Messages are then put in reply order, each
after the message it answers, without the quoted lines and the line that
announces them.

Links are found as of a turn, not by pairing all quotations with all originals:
inside ranges of TURNS turns by a window, across ranges by the last turn of each
range. A passage repeated in a conversation of any length is spread over tasks,
and so is the numbering of a long conversation. The reply order comes from a
walk around every thread, kept as a linked list of two entries per message and
ranked by pointer jumping: a thread takes space linear in its messages and
rounds that grow with the logarithm of their number.

Defined results: null text counts as empty; a null conversation is one of its
own, apart from the empty one; a null turn stands before turn 0, as turn -1; a
passage without words is told by its other characters; a quotation of an unknown
passage is dropped from the text and links nothing; messages of one turn are
linked each by its own quotations; of several originals in one turn one is the
parent; repeated rows are numbered one after another; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import query, slices, table
from reviewloom.operators.ordering import group_index
from reviewloom.runtime import durable, hot_keys, salted_join

TURNS = 1024

# What a quoted passage is; the whole goes before its parts.
WHOLE, LINE, SENTENCE = 0, 1, 2

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ANNOUNCEMENT = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?…。])\s+")


def passage_hash(text: str) -> int | None:
    """Hash of the normalised passage; None if there is nothing in it."""
    plain = " ".join(WORD.findall(text.lower())) or "".join(text.split())
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) >> 1 if plain else None


def parse(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """Text without quotations, the (level, kind, hash) of quoted passages, hashes of its own passages."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        level = m.group(1).count(">") if m else 0
        if level:
            if not before:
                while own and not own[-1].strip():
                    own.pop()
                if own and ANNOUNCEMENT.match(own[-1]):
                    own.pop()
            if level != before:
                runs.append((level, []))
            runs[-1][1].append(line[m.end():])
        else:
            own.append(line)
        before = level
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    quotes: dict[tuple[int, int], int] = {}
    for level, lines in runs:
        whole = "\n".join(lines)
        for kind, parts in (WHOLE, [whole]), (LINE, lines), (SENTENCE, SENTENCE_END.split(whole)):
            for part in parts:
                if (h := passage_hash(part)) is not None:
                    quotes.setdefault((level, h), kind)
                    quotes[level, h] = min(quotes[level, h], kind)
    paragraphs = body.split("\n\n")
    parts = [body, *body.split("\n"), *paragraphs, *(s for p in paragraphs for s in SENTENCE_END.split(p))]
    passages = {h for part in parts if (h := passage_hash(part)) is not None}
    return body, sorted((level, kind, h) for (level, h), kind in quotes.items()), sorted(passages)


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv, turn, role, body, quotes and passages of every message."""
    rows = messages.select(
        # A null conversation and an empty one differ.
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("t"), "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    quote = pa.struct([("level", pa.int32()), ("kind", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            found = [parse(x) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([f[0] for f in found], pa.string()),
                 pa.array([[{"level": a, "kind": k, "h": h} for a, k, h in f[1]] for f in found], pa.list_(quote)),
                 pa.array([f[2] for f in found], pa.list_(pa.int64()))],
                names=["conv", "conv_id", "t", "turn", "role", "body", "quotes", "passages"])

    return rows.mapInArrow(
        run, f"conv string, conv_id {kinds['conv_id']}, t long, turn {kinds['turn']}, role string, body string, "
             "quotes array<struct<level:int,kind:int,h:long>>, passages array<long>")


def reply_links(parsed: DataFrame) -> DataFrame:
    """row, up (the row replied to), parent (its turn) and level of every message that quotes an earlier one.

    `parsed` holds a number `row` per message.
    """
    quotes = (parsed.where(F.size("quotes") > 0).select("conv", "t", "row", F.explode("quotes").alias("q"))
              .select(F.struct("conv", "q.h", "t").alias("asked"), "row", "q.level", "q.kind"))
    # Asked and answered once per passage and turn, however many messages quote it.
    counts = durable(quotes.groupBy("asked").agg(F.count("*").alias("n")))
    asked = counts.select("asked.conv", "asked.h", "asked.t")
    originals = (parsed.select("conv", "t", "row", F.explode("passages").alias("h"))
                 .join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
                 .groupBy("conv", "h", "t").agg(F.max(F.struct("t", "row")).alias("original")))
    events = (asked.withColumn("original", F.lit(None).cast("struct<t:long,row:long>"))
              .unionByName(originals).withColumn("part", F.floor(F.col("t") / F.lit(TURNS))))
    earlier = Window.partitionBy("conv", "h", "part").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    parts = events.groupBy("conv", "h", "part").agg(F.max("original").alias("last"))
    earlier_parts = Window.partitionBy("conv", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv", "h", "part", F.max("last").over(earlier_parts).alias("carried"))
    found = (events.withColumn("near", F.max("original").over(earlier)).where(F.col("original").isNull())
             .join(carried, ["conv", "h", "part"])
             .select(F.struct("conv", "h", "t").alias("asked"), F.coalesce("near", "carried").alias("found"))
             .where(F.col("found").isNotNull()))
    answered = salted_join(quotes, found, "asked", hot_keys(counts, "asked", "n"), ["row", "level"])
    # The outermost level, there the largest kind of part, there the last original.
    best = F.max(F.struct((-F.col("level")).alias("level"), (-F.col("kind")).alias("kind"), "found"))
    return answered.groupBy("row").agg(best.alias("b")).select(
        "row", F.col("b.found.row").alias("up"), F.col("b.found.t").alias("parent"), (-F.col("b.level")).alias("level"))


def reply_order(links: DataFrame, places: DataFrame) -> DataFrame:
    """row, root, rest and depth of every message of a thread; inside a thread a larger `rest` stands first.

    `places` gives every row its `at` among the messages of its conversation. The walk around a thread enters a
    message, goes around its replies in their order and leaves it; entries are 2 * row, exits 2 * row + 1.
    """
    replies = links.select("row", "up").join(places, "row")
    numbered = durable(group_index(replies, "up", [F.col("at")], "k").select("row", "up", "k"))
    first = numbered.where("k = 0").select(F.col("up").alias("row"), F.col("row").alias("child"))
    following = numbered.select("up", (F.col("k") - 1).alias("k"), F.col("row").alias("sibling"))
    inner = numbered.join(following, ["up", "k"], "left").select("row", "up", "sibling")
    roots = numbered.select(F.col("up").alias("row")).distinct().join(numbered, "row", "left_anti")
    none = F.lit(None).cast("long")
    nodes = (inner.unionByName(roots.select("row", none.alias("up"), none.alias("sibling")))
             .join(first, "row", "left"))
    enter, leave = F.col("row") * 2, F.col("row") * 2 + 1
    steps = F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.lit(1).alias("enters")),
        F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"),
                 F.lit(0).alias("enters")))
    # Entries and exits from here to before `next`; `last` is the exit of the root, once that is reached.
    state = durable(nodes.select(F.explode(steps).alias("s")).select(
        "s.id", "s.next", F.col("s.enters").cast("long").alias("enters"),
        (1 - F.col("s.enters")).cast("long").alias("exits"),
        F.when(F.col("s.next").isNull(), F.col("s.id")).alias("last")))
    while not state.where(F.col("next").isNotNull()).isEmpty():
        # Lists that have reached their end are not looked up again.
        going, done = state.where(F.col("next").isNotNull()), state.where(F.col("next").isNull())
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("enters").alias("enters2"),
                             F.col("exits").alias("exits2"), F.col("last").alias("last2"))
        jumped = going.join(ahead, "next").select(
            "id", F.col("next2").alias("next"), (F.col("enters") + F.col("enters2")).alias("enters"),
            (F.col("exits") + F.col("exits2")).alias("exits"), F.col("last2").alias("last"))
        state = durable(jumped.unionByName(done))
    entered = state.where(F.col("id") % 2 == 0)
    return entered.select(
        F.shiftright("id", 1).alias("row"), F.shiftright("last", 1).alias("root"), F.col("enters").alias("rest"),
        (F.col("exits") - F.col("enters")).cast("int").alias("depth"))


def format_chats(messages: DataFrame) -> DataFrame:
    """Messages without quotations, in reply order.

    conv_id, turn, role, text, parent_turn, quote_level, depth, reply_pos (from 0
    inside the conversation) and formatted.
    """
    parsed = durable(parse_messages(messages).withColumn("row", F.monotonically_increasing_id()))
    links = durable(reply_links(parsed))
    order = [F.col("t"), F.coalesce("role", F.lit("")), F.col("body")]
    placed = durable(group_index(parsed.drop("quotes", "passages"), "conv", order, "at"))
    places = placed.select("row", "at")
    threads = reply_order(links, places).join(
        places.select(F.col("row").alias("root"), F.col("at").alias("root_at")), "root").drop("root")
    joined = (placed.join(links.drop("up"), "row", "left").join(threads, "row", "left")
              .withColumn("root_at", F.coalesce("root_at", "at")))
    numbered = group_index(joined, "conv", [F.col("root_at"), F.coalesce("rest", F.lit(1)).desc()], "reply_pos")
    role = F.coalesce("role", F.lit("unknown"))
    return numbered.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), F.col("parent").alias("parent_turn"),
        F.col("level").alias("quote_level"), F.coalesce("depth", F.lit(0)).alias("depth"), "reply_pos",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body")).alias("formatted"))


@query("op9_chat_format")
def op9_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))
