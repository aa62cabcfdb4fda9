"""Review table of a relational database, over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns analysis reads, of the eleven stored.
REVIEW_PROJECTION = [
    "app_id", "app_name", "title", "review", "rating", "category", "author_url", "author",
]


def jdbc_options(url: str, table: str, columns: list[str] | None = None,
                 key: str | None = None, bounds: tuple[int, int] | None = None,
                 parts: int | None = None, **other: str) -> dict[str, str]:
    """Options of a read; with a numeric key and its bounds it runs in parts."""
    source = f"(select {', '.join(columns)} from {table}) t" if columns else table
    options = {"url": url, "dbtable": source, **other}
    if key and bounds and parts:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return options


def read_reviews(spark: SparkSession, url: str, table: str = "reviews",
                 columns: list[str] | None = None, **options) -> DataFrame:
    """Review table with only the wanted columns read."""
    wanted = columns or REVIEW_PROJECTION
    if options.get("key") and options["key"] not in wanted:
        wanted = [options["key"], *wanted]
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, wanted, **options))
    return reader.load()


def write_reviews(df: DataFrame, url: str, table: str = "reviews", batch: int = 10_000,
                  **options: str) -> None:
    """Append rows in batches; a missing table is created with the database's own text type."""
    (df.write.format("jdbc").mode("append")
     .options(url=url, dbtable=table, batchsize=str(batch), **options).save())
