"""User-kept rewrite rules: storing them and applying them to tagged documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.functions.text import token
from reviewloom.operators.rewriting import merge_by_trie, reached_documents, read_reached
from reviewloom.runtime import durable, hot_keys, salted_join

Pair = tuple[str, str]
Rule = tuple[Sequence[Pair], Sequence[Pair]]

# More rules than this go by table or trie instead of one expression.
RULES_PER_PLAN = 100
# Rules are written by hand; more than this is taken for a mistake.
MAX_RULES = 100_000

_OPEN, _MID, _CLOSE = "\u0002", "\u0001", "\u0003"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{T.SPACE_CLASS}]+|[{T.SPACE_CLASS}]+$", "")


def _pairs(text: Column) -> Column:
    """Tab-separated lex and tag fields as pairs; an odd last field is dropped."""
    fields = F.split(_stripped(text), "\t")
    count = F.floor(F.size(fields) / 2).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(at, lambda i: token(F.get(fields, i * 2), F.get(fields, i * 2 + 1)))


def parse_rule(line: Column | str) -> Column:
    """Struct (before, after) of a line `lex pos ... >> lex pos ...`, tab-separated."""
    sides = F.split(F.col(line) if isinstance(line, str) else line, ">>")
    return F.struct(_pairs(F.get(sides, F.lit(0))).alias("before"),
                    _pairs(F.get(sides, F.lit(1))).alias("after"))


def format_rule(before: Column | str, after: Column | str) -> Column:
    """The line of a rule; the inverse of `parse_rule`."""
    def fields(pairs: Column | str) -> Column:
        return F.array_join(F.flatten(F.transform(pairs, lambda t: F.array(t.lex, t.pos))), "\t")
    return F.concat(fields(before), F.lit("\t>>\t"), fields(after))


def rules_of_mapping(mapping: DataFrame, lex: str, after: str, unknown: str = "NA") -> DataFrame:
    """Rules (before, after) that turn an unknown `lex` into the pairs `after`."""
    return mapping.select(
        F.array(token(F.col(lex), F.lit(unknown))).alias("before"), F.col(after).alias("after"))


def rule_pairs(rules: DataFrame) -> DataFrame:
    """Rules as rows (rule_no, side, pair_no, lex, pos)."""
    def side(name: str) -> DataFrame:
        return rules.select("rule_no", F.lit(name).alias("side"),
                            F.posexplode(name).alias("pair_no", "t"))
    rows = side("before").unionByName(side("after"))
    return rows.select("rule_no", "side", "pair_no", "t.lex", "t.pos")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Stored rules (rule_no, before, after) in file and line order, from 1.

    The files of one writing follow each other. Only their numbers of rules meet in one task; a file is a task's part.
    """
    # Of a written file the name of the writing goes before the number of the part.
    order = F.struct(F.regexp_replace("file", r"part-\d+-([^/]*)$", "$1").alias("writing"), "file")
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"),
        F.filter(F.split("value", "\n"), lambda line: line.contains(">>")).alias("lines"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.size("lines").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    lines = files.join(F.broadcast(offsets), "file").select("off", F.posexplode("lines").alias("at", "line"))
    numbered = lines.select((F.col("off") + F.col("at") + 1).cast("int").alias("rule_no"), parse_rule("line").alias("r"))
    return numbered.select("rule_no", "r.before", "r.after")


def new_rules(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed rules that are not stored, each once.

    Both sides hold (before, after).
    """
    line = format_rule("before", "after").alias("line")
    fresh = proposed.select("before", "after", line).dropDuplicates(["line"])
    return fresh.join(stored.select(line), "line", "left_anti").select("before", "after")


def refused_rules(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed rules that are stored already."""
    line = format_rule("before", "after").alias("line")
    return (proposed.select("before", "after", line)
            .join(stored.select(line), "line", "left_semi").select("before", "after"))


def write_rules(rules: DataFrame, path: str, append: bool = True) -> None:
    """Store rules in the order of their partitions; appending adds files, otherwise the table is replaced."""
    lines = rules.select(format_rule("before", "after").alias("value"))
    lines.write.mode("append" if append else "overwrite").text(path)


def collect_rules(rules: DataFrame) -> list[Rule]:
    """The rule list in rule order, for the expressions below."""
    rows = rules.orderBy("rule_no").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")

    def pairs(side: Sequence) -> list[Pair]:
        return [(t["lex"], t["pos"]) for t in side]
    return [(pairs(r["before"]), pairs(r["after"])) for r in rows]


def _tokens_of(pairs: Sequence[Pair]) -> Column:
    made = [token(F.lit(lex), F.lit(pos)) for lex, pos in pairs]
    return F.array(*made) if made else F.from_json(
        F.lit("[]"), "array<struct<lex:string,pos:string>>")


def _split_token(lex: Column, key: str, after: Sequence[Pair], retokenise: T.Tokenizer) -> Column:
    """Every occurrence of the key becomes `after`; the text around is tokenised again."""
    none = _tokens_of([])
    pieces = F.split(lex, "\\Q" + key + "\\E")
    return F.flatten(F.transform(pieces, lambda p, i: F.concat(
        F.when(i > 0, _tokens_of(after)).otherwise(none),
        F.when(p != "", retokenise(p)).otherwise(none))))


def split_expr(tokens: Column | str, rules: Sequence[Rule], retokenise: T.Tokenizer) -> Column:
    """Apply one-token rules to the unknown tokens that contain their key.

    The key is taken literally and the first rule that matches wins.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    single = [r for r in rules if len(r[0]) == 1]
    if not single:
        return col

    def rewrite(t: Column) -> Column:
        out = None
        for before, after in single:
            key = before[0][0]
            hit = t.pos.isin(T.UNKNOWN_TAGS) & t.lex.contains(key)
            made = _split_token(t.lex, key, after, retokenise)
            out = F.when(hit, made) if out is None else out.when(hit, made)
        return out.otherwise(F.array(token(t.lex, t.pos)))

    # Most documents hold no key and are not taken apart.
    def holds(t: Column) -> Column:
        found = None
        for before, _ in single:
            found = t.lex.contains(before[0][0]) if found is None else found | t.lex.contains(before[0][0])
        return t.pos.isin(T.UNKNOWN_TAGS) & found

    odd = F.exists(col, lambda t: t.isNull()) & F.exists(col, lambda t: t.pos.isin(T.UNKNOWN_TAGS))
    touched = F.coalesce(F.exists(col, holds), F.lit(False)) | F.coalesce(odd, F.lit(False))
    return F.when(touched, F.flatten(F.transform(col, rewrite))).otherwise(col)


def _encoded(pairs: Sequence[Pair]) -> str:
    return "".join(f"{_OPEN}{lex}{_MID}{pos}{_CLOSE}" for lex, pos in pairs)


def merge_expr(tokens: Column | str, rules: Sequence[Rule]) -> Column:
    """Replace neighbouring token runs, leftmost first, without rescanning.

    A document becomes one string with control characters around each token,
    so a run of tokens is a substring and the replacement is one built-in call.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    longer = [r for r in rules if len(r[0]) > 1]
    if not longer:
        return col
    parts = F.transform(col, lambda t: F.concat(
        F.lit(_OPEN), t.lex, F.lit(_MID), t.pos, F.lit(_CLOSE)))
    whole = doc = F.array_join(parts, "")
    held = None
    for before, after in longer:
        here = F.contains(whole, F.lit(_encoded(before)))
        held = here if held is None else held | here
        doc = F.replace(doc, F.lit(_encoded(before)), F.lit(_encoded(after)))
    coded = F.filter(F.split(doc, _CLOSE), lambda x: x != "")
    made = F.transform(coded, lambda x: token(
        F.substring_index(x, _MID, 1).substr(F.lit(2), F.length(x)),
        F.substring_index(x, _MID, -1)))
    # A document without a run stays as it is, unless it has tokens with nulls, which are dropped.
    odd = F.exists(col, lambda t: t.isNull() | t.lex.isNull() | t.pos.isNull())
    return F.when(held | odd, made).otherwise(col)


def split_by_table(docs: DataFrame, rules: Sequence[Rule], doc: str, tokens: str,
                   retokenise: T.Tokenizer) -> DataFrame:
    """`split_expr` for rule lists too long for one expression.

    Each distinct unknown token finds its first rule by `rule_matches`; the
    results are joined back to the tokens with frequent ones split.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != tokens]
    rows = docs.select(doc, F.posexplode(tokens).alias("seq", "t"))
    rows = rows.select(doc, "seq", "t.lex", "t.pos",
                       F.col("t.pos").isin(T.UNKNOWN_TAGS).alias("unknown"))
    counts = rows.where("unknown").groupBy("lex").agg(F.count("*").alias("n"))
    single = [(i, r[0][0][0], list(r[1])) for i, r in enumerate(rules) if len(r[0]) == 1]
    table = F.broadcast(spark.createDataFrame(
        single, "rule_no int, key string, after array<struct<lex:string,pos:string>>"))
    first = (rule_matches(counts, [key for _, key, _ in single]).join(table, "key")
             .groupBy("lex").agg(F.min_by(F.struct("key", "after"), "rule_no").alias("r")))
    pieces = F.split("lex", F.concat(F.lit("\\Q"), F.col("r.key"), F.lit("\\E")))
    none = _tokens_of([])
    made = F.flatten(F.transform(pieces, lambda p, i: F.concat(
        F.when(i > 0, F.col("r.after")).otherwise(none),
        F.when(p != "", retokenise(p)).otherwise(none))))
    found = first.select("lex", F.lit(True).alias("unknown"), made.alias("made"))
    hot = hot_keys(counts, "lex", "n")
    joined = salted_join(rows, found.drop("unknown"), "lex", hot, [doc, "seq"], "left")
    part = F.when(F.col("unknown") & F.col("made").isNotNull(), F.col("made")).otherwise(
        F.array(token(F.col("lex"), F.col("pos"))))
    ordered = F.sort_array(F.collect_list(F.struct("seq", part.alias("part"))))
    rebuilt = joined.groupBy(doc).agg(
        F.flatten(F.transform(ordered, lambda x: x.part)).alias(tokens))
    return docs.select(*others).join(rebuilt, doc, "left").withColumn(
        tokens, F.coalesce(tokens, none))


def apply_rules(docs: DataFrame, rules: Sequence[Rule], doc: str = "doc_id",
                tokens: str = "tokens", split: bool = True, merge: bool = True,
                retokenise: T.Tokenizer = T.tag_by_script) -> DataFrame:
    """Split rules first, then merge rules, each kind in rule order.

    A long list of merge rules goes through `merge_by_trie`, a short one is an
    expression; a test holds both against rule by rule.
    """
    if split:
        single = [r for r in rules if len(r[0]) == 1]
        if len(single) > RULES_PER_PLAN:
            docs = split_by_table(docs, single, doc, tokens, retokenise)
        else:
            docs = docs.withColumn(tokens, split_expr(tokens, single, retokenise))
    if merge:
        longer = [r for r in rules if len(r[0]) > 1]
        if len(longer) > RULES_PER_PLAN:
            docs = merge_by_trie(docs, longer, tokens)
        else:
            docs = docs.withColumn(tokens, merge_expr(tokens, longer))
    return docs


def rewrite_reached(docs: DataFrame | Callable[[DataFrame], DataFrame], postings: DataFrame, rules: Sequence[Rule], doc: str = "doc_id",
                    tokens: str = "tokens", split: bool = True, merge: bool = True,
                    retokenise: T.Tokenizer = T.tag_by_script, buckets: int | None = None) -> DataFrame:
    """`apply_rules` on only the documents that the inverted index names; the others are not in the result.

    `postings` comes from `token_postings`. Documents stored by `write_by_bucket` are read by their buckets if
    `buckets` tells how many there are. `docs` may be a function that gives the documents of a table of ids, where it
    would cost more to make all of them.
    """
    reached = durable(reached_documents(postings, rules, doc, split, merge))
    if callable(docs):
        some = docs(reached)
    elif buckets:
        some = read_reached(docs, reached, doc, buckets)
    else:
        some = docs.join(reached, doc, "left_semi").select(docs.columns)
    return apply_rules(some, rules, doc, tokens, split, merge, retokenise)


def rule_matches(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unknown tokens (lex, n) that contain a rule key, (key, lex, n).

    Substrings of the key lengths meet the keys in an equal join, so the work
    does not grow with tokens times rules.
    """
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")

    def pieces(width: int) -> Column:
        last = F.length("lex") - F.lit(width - 1)
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.col("lex").substr(i, F.lit(width)))

    widths = sorted({len(k) for k in keys})
    parts = F.array_distinct(F.concat(*[pieces(w) for w in widths]))
    return (counts.select("lex", "n", F.explode(parts).alias("key"))
            .join(F.broadcast(wanted), "key").select("key", "lex", "n"))
