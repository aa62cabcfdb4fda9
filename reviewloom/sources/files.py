"""Review files: JSON lines, JSON documents, TSV, text lists, quoted CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewloom import schemas
from reviewloom.functions import fields
from reviewloom.functions import tokens as K

# Fixed value: lines per scraped file when files are named by index range.
BATCH_SIZE = 100


def read_jsonl(spark: SparkSession, path, key_ma: bool = True, only_ma: bool = False) -> DataFrame:
    """One review per line, with tokens in `ma` or text in `review`.

    `only_ma` leaves the id and the tokens; other fields are then not parsed.
    """
    schema = schemas.DOCS_MA_JSONL if key_ma else schemas.DOCS_JSONL
    if only_ma:
        schema = StructType([schema["app_id"], schema["ma" if key_ma else "review"]])
    df = _good_lines(spark, path, schema)
    return df.withColumn("ma", K.from_pairs("ma")) if key_ma else df


def _parsed(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """Lines that are not blank, parsed into `r`; what cannot be parsed is in `r._bad`."""
    with_bad = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("r", F.from_json("value", with_bad,
                                             {"columnNameOfCorruptRecord": "_bad"}))


def _good_lines(spark: SparkSession, path, schema: StructType) -> DataFrame:
    rows = _parsed(spark, path, schema).where("r._bad IS NULL")
    return rows.select(*[F.col(f"r.{f.name}") for f in schema.fields])


def bad_lines(spark: SparkSession, path, schema: StructType = schemas.DOCS_MA_JSONL) -> DataFrame:
    """Lines the readers leave out as broken, (file, line); count them to know what is missing."""
    return (_parsed(spark, path, schema).where("r._bad IS NOT NULL")
            .select(F.input_file_name().alias("file"), F.col("value").alias("line")))


def read_jsonl_terms(spark: SparkSession, path, by_app: bool = False) -> DataFrame:
    """As `read_jsonl` for documents whose tokens are `lex/pos` strings."""
    return _good_lines(spark, path,
                       schemas.DOCS_BY_APP_JSONL if by_app else schemas.DOCS_VOCAB_JSONL)


def write_jsonl(df: DataFrame, path: str, only_ma: bool = False) -> None:
    """One review per line; struct tokens are written as two-element lists."""
    types = dict(df.dtypes)
    if types.get("ma", "").startswith("array<struct"):
        df = df.withColumn("ma", K.to_pairs("ma"))
    if only_ma:
        df = df.select("app_id", "ma" if "ma" in types else "review")
    df.write.json(path)


def read_json_documents(spark: SparkSession, path) -> DataFrame:
    """Whole-file JSON objects of word lists, one row (key, words) per entry."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>"))
                       .alias("key", "words"))


def bad_json_documents(spark: SparkSession, path) -> DataFrame:
    """Files that `read_json_documents` leaves out as broken."""
    text = spark.read.text(path, wholetext=True)
    return text.where(F.from_json("value", "map<string,array<string>>").isNull()).select(
        F.input_file_name().alias("file"))


def write_json_documents(df: DataFrame, path: str, key: str, words: str) -> None:
    """One JSON object `{key: words}` per line, in as many files as tasks."""
    df.select(F.to_json(F.create_map(key, words)).alias("value")).write.text(path)


def read_keywords(spark: SparkSession, path) -> DataFrame:
    """What `write_json_documents` wrote."""
    text = spark.read.text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>"))
                       .alias("key", "words"))


def batch_names(prefix: str, total: int, first: int = 1, last: int | None = None) -> list[str]:
    """Names of scraped files by index range, such as `n_reviews[1-100].txt`.

    `first` and `last` choose files by their 1-based place.
    """
    starts = range(1, total + 1, BATCH_SIZE)
    names = [f"{prefix}[{a}-{min(a + BATCH_SIZE - 1, total)}].txt" for a in starts]
    return names[first - 1:last]


def literal(name: str) -> str:
    """A file name in which brackets are not taken for a pattern."""
    return name.replace("[", "\\[").replace("]", "\\]")


def read_tsv(spark: SparkSession, paths, schema: StructType = schemas.REVIEWS_RAW,
             lineage: bool = False) -> DataFrame:
    """Scraped TSV files with header; all strings, NaN is NULL."""
    df = (spark.read.schema(schema).option("sep", "\t").option("header", True)
          .option("quote", "").option("nullValue", "NaN").option("lineSep", "\n").csv(paths))
    return df.withColumn("file", F.input_file_name()) if lineage else df


def write_tsv(df: DataFrame, path: str, clean: bool = False) -> None:
    """TSV with header; `clean` makes every field safe and writes NULL as NaN."""
    if clean:
        df = df.select(*[fields.for_tsv(c).alias(c) for c in df.columns])
    (df.write.option("sep", "\t").option("header", True).option("quote", "")
     .option("nullValue", "NaN").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Id or link list, one per line, without outer blanks."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def line_count(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("lines"))


def write_lines(df: DataFrame, path: str, value: Column | str) -> None:
    """One value per line."""
    col = F.col(value) if isinstance(value, str) else value
    df.select(col.cast("string").alias("value")).write.text(path)


def token_line(tokens: Column | str) -> Column:
    """A document as blank-separated tokens."""
    return F.array_join(tokens, " ")


def write_csv_parts(df: DataFrame, path: str, parts: int) -> None:
    """Quoted CSV in `parts` files; reading the folder merges them."""
    (df.repartition(parts).write.option("quoteAll", True).option("escape", "\"")
     .option("header", False).csv(path))


def read_csv_parts(spark: SparkSession, path, schema: StructType) -> DataFrame:
    return (spark.read.schema(schema).option("escape", "\"").option("multiLine", True)
            .option("header", False).csv(path))


def save_table(df: DataFrame, name: str, path: str, schema: StructType) -> None:
    """Create a table of fixed schema and fill it."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]) \
        .write.option("path", path).mode("overwrite").saveAsTable(name)
