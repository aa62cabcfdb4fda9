"""Group tables: per-app documents, first rows, cross-tabs and their flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reviews of neighbouring ids that are put into one part of an app's document.
PART_SPAN = 256
# Columns a cross-tab may get.
MAX_COLUMNS = 1000


def part_of(seq: Column | str, span: int = PART_SPAN) -> Column:
    """Part number of a review: its id divided by the span.

    A part holds at most `span` reviews, and parts in order give the whole
    document in order, whatever the size of the app.
    """
    return F.floor(F.col(seq) / F.lit(span)) if isinstance(seq, str) else F.floor(seq / span)


def per_app_docs(docs: DataFrame, app: str, seq: str, tokens: str, *first: str,
                 rating: str | None = None, span: int = PART_SPAN) -> DataFrame:
    """Documents of an app put together in order, in parts of bounded size.

    Gives app, part, number of docs, `tokens` in order, the `first` columns
    (name, category) from the first review of the part, and the ratings.
    """
    row = F.struct(F.col(seq).alias("seq"), F.col(tokens).alias("tokens"),
                   *([F.col(rating).alias("rating")] if rating else []))
    ordered = F.sort_array(F.collect_list(row))
    aggs = [F.count("*").alias("docs"),
            F.flatten(F.transform(ordered, lambda x: x.tokens)).alias("tokens"),
            *[F.min_by(c, seq).alias(c) for c in first]]
    if rating:
        aggs.append(F.transform(ordered, lambda x: x.rating).alias("rating"))
    return docs.groupBy(app, part_of(seq, span).alias("part")).agg(*aggs)


def first_per_app(docs: DataFrame, app: str, seq: str, *cols: str) -> DataFrame:
    """First review of every app, by a mergeable aggregate instead of a sort."""
    return docs.groupBy(app).agg(
        F.min(seq).alias(seq), *[F.min_by(c, seq).alias(c) for c in cols])


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def distinct_with_null(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, NULL counted as one, as len(unique()) does."""
    has_null = F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))
    return df.agg((F.count_distinct(col) + has_null).alias("n"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of `row` by `col` in wide form, missing pairs 0."""
    counts = group_counts(df, row, col)
    found = counts.select(col).distinct().limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{col} has more than {MAX_COLUMNS} values")
    values = sorted(r[0] for r in found)
    return counts.groupBy(row).pivot(col, values).agg(F.sum("n")).na.fill(0)


def crosstab_flags(counts: DataFrame, row: str, col: str, n: str = "n", large: int = 10,
                   words: list[str] = ()) -> DataFrame:
    """What the styled table shows, as columns.

    Largest of its row, largest of its column, zero, above `large`, and `col`
    among `words`. `counts` holds one row per pair. A row or column may have
    very many pairs, so their maxima are aggregated and joined back.
    """
    def top(by: str) -> DataFrame:
        return counts.groupBy(F.col(by).alias(f"_{by}")).agg(F.max(n).alias(f"_max_{by}"))
    with_max = counts
    for by in (row, col):
        with_max = with_max.join(top(by), F.col(by).eqNullSafe(F.col(f"_{by}"))).drop(f"_{by}")
    return with_max.withColumns({
        "is_row_max": F.col(n) == F.col(f"_max_{row}"),
        "is_col_max": F.col(n) == F.col(f"_max_{col}"),
        "is_zero": F.col(n) == 0, "is_large": F.col(n) > large,
        "is_word": F.col(col).isin(list(words)) if words else F.lit(False),
    }).drop(f"_max_{row}", f"_max_{col}")


def first_rank(df: DataFrame, key: str, wanted: list[str], size: str, row_id: str,
               rank: str) -> DataFrame:
    """Rank of the first row of each wanted key among all rows, largest `size` first.

    Equal sizes go by `row_id`. The best row of a key comes from one aggregate
    and its rank is the number of rows before it, so nothing is sorted.
    """
    best = (df.where(F.col(key).isin(wanted)).groupBy(key).agg(
        F.max(F.struct(F.col(size), -F.col(row_id))).alias("best")).collect())
    if not best:
        return df.select(key, F.lit(0).cast("bigint").alias(rank)).limit(0)

    def before(n: int, i: int) -> Column:
        return (F.col(size) > F.lit(n)) | ((F.col(size) == F.lit(n)) & (F.col(row_id) < F.lit(-i)))
    counts = df.agg(*[F.count_if(before(r["best"][0], r["best"][1])).alias(f"_{k}")
                      for k, r in enumerate(best)])
    rows = [F.struct(F.lit(r[key]).alias(key), (F.col(f"_{k}") + 1).alias(rank))
            for k, r in enumerate(best)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select(f"r.{key}", f"r.{rank}")
