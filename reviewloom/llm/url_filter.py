"""URL filter by a tree of path templates per host, in DataFrame functions only.

Written rules judge the urls they fit; the longest rule wins. All other urls are
judged by their template. Every host has a tree of path segments. Digits and
hashes in segments become wildcards at once. Then, level by level from the
host, a branch is compared with the sums of all branches of its parent whose
names are of its kind (with or without a number). It is merged into `*` (or
`*{n}`) if the mix of what follows it and its labelled purity are theirs: the
difference is small, or no larger than chance explains in so few urls. So an
unlabelled branch goes with siblings of its shape. The labels are the verdicts
of the rules. A template is rejected if the share of blocked urls among its
labelled ones, smoothed towards one half, is high enough.

The tree is held as one row per distinct template, counted before anything is
compared, and branches are compared with their parent's sums, never with each
other. A host with a third of all urls is thus as many rows as it has
templates, and joins split hot parents, branches and templates. Levels are built
while templates share a node: a template that is alone below its node has no
branches to compare and leaves, so the number of rounds is the longest path that
two templates have in common.

Defined results: a null url, or one without `://`, has empty host and path and
the verdict of that (empty) template; repeated urls each get their row; very
long urls are taken whole; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import query, table
from reviewloom.runtime import durable, hot_keys, salted_join, scratch_path

# Rules of the registered query, as (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# Differences that are small in any number of urls, in shares that follow and in purity.
CLOSE_MIX = 0.2
CLOSE_PURITY = 0.1
# Differences that chance explains: chi-square of three degrees and of one, each at 0.001.
CHANCE_MIX, CHANCE_PURITY = 16.27, 10.83
SMOOTHING = 4
REJECT = 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = "^[0-9a-f]{16,}$|^[0-9a-f-]{32,}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty without `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _split(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule that fits and its verdict, or null; a rule fits its host and all subdomains."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = _split(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def segments(path: Column) -> Column:
    """The segments with digits and hashes as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(
        s.rlike(HASH), F.lit("{x}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))


def _kind(segment: Column) -> Column:
    """What a segment is: nothing, a number, a name with a number, another name."""
    return (F.when(segment.isNull(), F.lit(0)).when(segment == "{n}", F.lit(1))
            .when(segment.contains("{n}"), F.lit(2)).otherwise(F.lit(3)))


SUMS = ["n", "blocked", "labelled", "k0", "k1", "k2", "k3"]


def _purity(blocked: Column, labelled: Column) -> Column:
    return (blocked + F.lit(SMOOTHING / 2)) / (labelled + F.lit(SMOOTHING))


def _same_mix() -> Column:
    """Whether what follows a branch is mixed as below the group `p_`."""
    def part(k: int) -> Column:
        return F.col("n").cast("double") * F.col(f"p_k{k}") / F.col("p_n")
    apart = sum((F.abs(F.col(f"k{k}") / F.col("n") - F.col(f"p_k{k}") / F.col("p_n")) for k in range(4)), F.lit(0.0))
    chance = sum((F.when(F.col(f"p_k{k}") > 0, (F.col(f"k{k}") - part(k)) * (F.col(f"k{k}") - part(k)) / part(k))
                  .otherwise(F.lit(0.0)) for k in range(4)), F.lit(0.0))
    return (apart <= 2 * CLOSE_MIX) | (chance <= CHANCE_MIX)


def _same_purity() -> Column:
    """Whether the labels of a branch are those of the group `p_`; a branch without labels agrees."""
    labelled, blocked = F.col("labelled").cast("double"), F.col("blocked")
    q = _purity(F.col("p_blocked"), F.col("p_labelled"))
    away = blocked - labelled * q
    return ((F.col("labelled") == 0) | (F.abs(away) <= labelled * CLOSE_PURITY)
            | (away * away <= labelled * q * (1 - q) * CHANCE_PURITY))


def merge_level(tree: DataFrame, level: int) -> DataFrame:
    """Append the name at `level` (its own or a wildcard) to `node` of every template, all of which reach that level."""
    own, following = F.element_at("parts", level), F.get("parts", F.lit(level))
    rows = tree.withColumn("branch", F.struct("node", own.alias("own")))
    kinds = [F.sum(F.when(_kind(following) == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)]
    branches = durable(rows.groupBy("branch").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"),
        F.count("*").alias("templates"), *kinds).withColumn("parent", F.struct(
            "branch.node", _kind(F.col("branch.own")).alias("kind"))))
    parents = branches.groupBy("parent").agg(
        *[F.sum(c).alias(f"p_{c}") for c in SUMS], F.count("*").alias("branches"))
    # A number is a wildcard already, and an only branch stays.
    merged = (F.col("parent.kind") >= 2) & (F.col("branches") > 1) & _same_purity() & _same_mix()
    wild = F.when(F.col("parent.kind") == 2, F.lit("*{n}")).otherwise(F.lit("*"))
    named = salted_join(branches, parents, "parent", hot_keys(parents, "parent", "branches"), "branch").select(
        "branch", F.when(merged, wild).otherwise(F.col("branch.own")).alias("name"))
    return (salted_join(rows, named, "branch", hot_keys(branches, "branch", "templates"), "key")
            .withColumn("node", F.concat_ws("/", "node", "name")).drop("branch", "name"))


def _stored(df: DataFrame) -> DataFrame:
    """The rows as a written table: unlike a checkpoint, it doesn't hand on the conditions that Spark derives from the
    plan, which would grow with every level."""
    path = scratch_path(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def templates_of(tree: DataFrame) -> DataFrame:
    """The rows of the tree (key, node, parts, n, blocked, labelled) with their template as `node`."""
    level, done = 1, []
    while True:
        # Alone below its node, or at its end.
        alone = tree.groupBy("node").agg(F.count("*").alias("below"))
        shared = durable(salted_join(tree, alone, "node", hot_keys(alone, "node", "below"), "key"))
        going = (F.col("below") > 1) & (F.size("parts") >= level)
        rest = F.slice("parts", level, F.greatest(F.size("parts") - level + 1, F.lit(0)))
        done.append(shared.where(~going).withColumn("node", F.concat_ws("/", "node", rest)).drop("below"))
        tree = shared.where(going).drop("below")
        if tree.isEmpty():
            break
        tree = _stored(merge_level(tree, level))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], row_id: str = "page_id", url: str = "url") -> DataFrame:
    """Id, host, path, rule, verdict, template and its purity, one row per page."""
    host, path = host_and_path(F.col("url"))
    rows = (pages.select(F.col(row_id).alias("row_id"), F.col(url).alias("url"))
            .select("row_id", host.alias("host"), path.alias("path")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = (rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("parts", segments(F.col("path")))
            .withColumn("key", F.concat("host", F.lit("/"), F.concat_ws("/", "parts"))))
    tree = rows.groupBy("key", "host", "parts").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"),
        F.count("ruled").alias("labelled"))
    tree = durable(templates_of(durable(tree.withColumnRenamed("host", "node"))))
    templates = tree.groupBy("node").agg(
        _purity(F.sum("blocked"), F.sum("labelled")).alias("purity"), F.count("*").alias("keys"))
    judged = durable(salted_join(tree.select("key", "node", "n"), templates.drop("keys"), "node",
                                 hot_keys(templates, "node", "keys"), "key"))
    found = salted_join(rows, judged.drop("n"), "key", hot_keys(judged, "key", "n"), ["row_id", "path"], "left")
    return found.select(
        F.col("row_id").alias(row_id), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"), F.col("node").alias("template"), "purity")


def _rule_case(value: int) -> str:
    lines = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        h, p = _split(rule[1])
        lines.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{rule[value]}'")
    return "CASE " + " ".join(lines) + " END"


def _kind_sql(segment: str) -> str:
    return (f"CASE WHEN {segment} IS NULL THEN 0 WHEN {segment} = '{{n}}' THEN 1 "
            f"WHEN contains({segment}, '{{n}}') THEN 2 ELSE 3 END")


_BRANCH, _PARENT = "PARTITION BY node, own", "PARTITION BY node, own_kind"
_APART = " + ".join(f"abs(k{k} / n_b - p_k{k} / p_n)" for k in range(4))
_CHANCE = " + ".join(f"CASE WHEN p_k{k} > 0 THEN (k{k} - n_b * p_k{k} / p_n) * (k{k} - n_b * p_k{k} / p_n) "
                     f"/ (n_b * p_k{k} / p_n) ELSE 0.0::DOUBLE END" for k in range(4))

SQL_TEXT = rf"""
WITH RECURSIVE u0 AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u0),
u2 AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host,
       regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u1),
u3 AS (SELECT *, {_rule_case(1)} AS rule, {_rule_case(0)} AS ruled,
       list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM u2),
u4 AS (SELECT *, list_transform(l, lambda x: CASE WHEN regexp_matches(x, '{HASH}') THEN '{{x}}'
       ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END) AS parts FROM u3),
u AS (SELECT *, host || '/' || coalesce(array_to_string(parts, '/'), '') AS key FROM u4),
t AS (
  SELECT key, host AS node, parts, count(*)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS blocked,
         count(ruled)::DOUBLE AS labelled, 1::BIGINT AS level FROM u GROUP BY key, host, parts
  UNION ALL
  SELECT key, node || '/' || CASE WHEN own_kind >= 2 AND p_n > n_b
           AND (labelled_b = 0 OR abs(blocked_b - labelled_b * q) <= labelled_b * {CLOSE_PURITY}::DOUBLE
                OR (blocked_b - labelled_b * q) * (blocked_b - labelled_b * q)
                   <= labelled_b * q * (1 - q) * {CHANCE_PURITY}::DOUBLE)
           AND ({_APART} <= {2 * CLOSE_MIX}::DOUBLE OR {_CHANCE} <= {CHANCE_MIX}::DOUBLE)
         THEN CASE WHEN own_kind = 2 THEN '*{{n}}' ELSE '*' END ELSE own END,
         parts, n, blocked, labelled, level + 1
  FROM (SELECT *, (p_blocked + {SMOOTHING / 2}::DOUBLE) / (p_labelled + {SMOOTHING}::DOUBLE) AS q FROM (
    SELECT *, {", ".join(f"sum({c}) OVER ({_BRANCH}) AS {c}_b" for c in ("n", "blocked", "labelled"))},
           {", ".join(f"sum({c}) OVER ({_PARENT}) AS p_{c}" for c in ("n", "blocked", "labelled"))},
           {", ".join(f"sum(CASE WHEN kind = {k} THEN n ELSE 0 END) OVER ({_BRANCH}) AS k{k}" for k in range(4))},
           {", ".join(f"sum(CASE WHEN kind = {k} THEN n ELSE 0 END) OVER ({_PARENT}) AS p_k{k}" for k in range(4))}
    FROM (SELECT *, parts[level] AS own, {_kind_sql("parts[level]")} AS own_kind, {_kind_sql("parts[level + 1]")} AS kind
          FROM t WHERE level <= len(parts))))),
e AS (SELECT * FROM t WHERE level = len(parts) + 1),
f AS (SELECT node, (sum(blocked) + {SMOOTHING / 2}::DOUBLE) / (sum(labelled) + {SMOOTHING}::DOUBLE) AS purity
      FROM e GROUP BY node)
SELECT u.page_id, u.host, u.path, u.rule,
       coalesce(u.ruled, CASE WHEN f.purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       e.node AS template, f.purity AS purity
FROM u JOIN e ON u.key = e.key JOIN f ON e.node = f.node
"""


@query("op3_url_filter", SQL_TEXT)
def op3_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES)
