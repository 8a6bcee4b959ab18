"""Reading and writing: lines, CSV, JSON, JSON lines, compressed dumps, embeddings, edges, cached results, models.

Readers return DataFrames and stay lazy; writers write folders of part files, as Spark does. All text is UTF-8 unless said otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..session import materialise
from .workbook import read_workbook


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``, a row per line; .bz2 and .gz are read as what they hold, the former in parallel."""
    return spark.read.text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(value)`` of a JSON array written one object a line: brackets and the commas behind the objects are left out."""
    line = F.rtrim(F.col("value"))
    bare = F.when(line.endswith(","), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return spark.read.text(path).select(bare.alias("value")).where(~F.col("value").isin("[", "]", ""))


def write_lines(df: DataFrame, path: str, append: bool = False, compression: str = "none") -> None:
    """Writes the only column of `df`, a line per row."""
    df.write.mode("append" if append else "overwrite").option("compression", compression).text(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` of a file source with their number from 0 as ``line``, files in the order of their names. Blocks of files are counted, rows neither moved nor gathered."""
    marked = materialise(rows.select(*rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")))
    blocks = marked.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # a row per block of a file
    offsets = blocks.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"))
    return marked.join(offsets, ["_file", "_block"]).select(*rows.columns, (F.col("_at") + F.col("_offset")).alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)``: the lines of a file, or of the files of a folder by name, numbered from 0."""
    return _numbered(spark.read.option("lineSep", "\n").text(path))


def write_aligned(docs: DataFrame, text: str, entities: str, path: str) -> None:
    """Texts and lists of entity ids as two sets of lines that belong together by position, ``path/text`` and ``path/entities``; line breaks in texts become spaces, null is an empty line."""
    given = materialise(docs.select(F.coalesce(F.translate(F.col(text), "\r\n", "  "), F.lit("")).alias("text"), F.coalesce(F.array_join(F.col(entities).cast("array<string>"), " "), F.lit("")).alias("entities")))
    for name in ("text", "entities"):
        given.select(name).write.mode("overwrite").text(f"{path}/{name}")


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """``(line, text, entities)`` of such files."""
    of = lambda name: numbered_lines(spark, f"{path}/{name}").withColumnRenamed("value", name)
    return of("text").join(of("entities"), "line").select("line", "text", F.filter(F.split("entities", " "), lambda x: x != "").alias("entities"))


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, delimiter: str = ",", quote: str = '"', encoding: str = "ISO-8859-1", header: bool = False) -> DataFrame:
    """Quotes within quoted fields are doubled, spaces before a field don't count; missing fields at the end of a line are null, surplus ones are left out."""
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_config_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line, in UTF-8."""
    return read_csv(spark, path, schema, encoding="UTF-8", header=True)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A file that is one JSON value, an array's elements as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON lines; damaged ones are left out, or raise an error with `strict` when the rows are read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def map_file(spark: SparkSession, source: str, target: str, f: Callable[[Column], Column]) -> None:
    """Applies `f` to every line of a file and writes what isn't null."""
    read_lines(spark, source).select(f(F.col("value")).alias("value")).where("value is not null").write.mode("overwrite").text(target)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, computed and written first where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def embedding_line(key: Column, vector: Column, digits: int = 8) -> Column:
    """An id and its numbers with a fixed number of decimals, parted by spaces."""
    number = lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))
    return F.concat_ws(" ", key, F.array_join(F.transform(vector, lambda x: number(x.cast("double"))), " "))


def write_embeddings(vectors: DataFrame, path: str, dims: int) -> None:
    """``(id, vec)`` as lines below a header line with both sizes, which stands first in its own file."""
    head = vectors.agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.col("n").cast("string"), F.lit(str(dims))).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    vectors.select(embedding_line(F.col("id"), F.col("vec")).alias("value")).write.mode("overwrite").text(f"{path}/part=1")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec)`` of such files, or of a single one; the header is told by its having two fields."""
    fields = F.split(F.trim("value"), " +")
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(fields.alias("f")).where(F.size("f") > 2)
    return rows.select(F.col("f")[0].alias("id"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: x.cast("float")).alias("vec"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string").option("sep", "\t").csv(path)


def write_merged_counts(counts: DataFrame, path: str) -> None:
    """A count table as CSV with a header."""
    counts.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_model(topics: DataFrame, centroids: list[list[float]], path: str, **parameters: object) -> None:
    """Topic words, centroids and parameters of a topic model."""
    spark = topics.sparkSession
    topics.write.mode("overwrite").parquet(f"{path}/topics")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "topic int, vec array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]], dict]:
    """The topics, centroids and parameters that `save_model` wrote."""
    centroids = [r.vec for r in spark.read.parquet(f"{path}/centroids").orderBy("topic").collect()]
    return spark.read.parquet(f"{path}/topics"), centroids, json.loads(spark.read.text(f"{path}/parameters").first().value)


def read_topics_sheet(spark: SparkSession, path: str, min_score: float = 1e-4, min_words: int = 1) -> DataFrame:
    """``(topic, label, place, id, word, score)`` of a sheet, a workbook or saved as CSV, with ``Topic No.``, ``Label`` or ``Topic Label``, perhaps ``Keep``, and ``Id i``, ``Word i``, ``Score i`` columns.

    Headers count in title case. Rows without a number or label, or with an empty or false ``Keep``, are left out; so are words up to `min_score` and topics
    with fewer than `min_words` of them. A missing score counts as 1 / place.
    """
    raw = read_workbook(spark, path) if path.endswith(".xlsx") else spark.read.option("header", True).option("escape", '"').csv(path)
    names = {c: " ".join(w[:1].upper() + w[1:].lower() for w in c.split()) for c in raw.columns}
    names = {c: "Topic Label" if n == "Label" else n for c, n in names.items()}
    df = raw.select(*[F.col(f"`{c}`").alias(n.replace(".", "")) for c, n in names.items()])
    df = df.withColumn("Topic No", F.regexp_replace("Topic No", r"\\.0$", "")) if "Topic No" in df.columns else df
    kept = df.where("`Topic No` is not null and `Topic Label` is not null")
    if "Keep" in df.columns:
        kept = kept.where(~F.lower(F.coalesce("Keep", F.lit("false"))).isin("false", "0", ""))
    places = sorted(int(c.split()[1]) for c in df.columns if c.startswith("Id ") and c.split()[1].isdigit())
    word = lambda i: F.struct(F.lit(i).alias("place"), F.col(f"Id {i}").alias("id"), (F.col(f"Word {i}") if f"Word {i}" in df.columns else F.lit(None).cast("string")).alias("word"), F.coalesce(F.col(f"Score {i}").cast("double") if f"Score {i}" in df.columns else F.lit(None).cast("double"), F.lit(1.0 / i)).alias("score"))
    rows = kept.select(F.col("Topic No").cast("int").alias("topic"), F.col("Topic Label").alias("label"), F.explode(F.array(*[word(i) for i in places])).alias("w")).select("topic", "label", "w.*").where(F.col("id").isNotNull() & (F.col("score") > min_score))
    enough = rows.groupBy("topic").count().where(F.col("count") >= min_words).select("topic")
    return rows.join(enough, "topic", "left_semi")


def read_ranked(spark: SparkSession, path: str, column: str, n: int | None = None) -> DataFrame:
    """``(value, rank)`` of a column of a CSV file with a header whose order is the rank, from 0; the first n with `n`."""
    ranked = _numbered(spark.read.option("header", True).csv(path)).select(F.col(column).alias("value"), F.col("line").alias("rank"))
    return ranked if n is None else ranked.where(F.col("rank") < n)


def row_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object with its keys in order, nulls left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias(name))


def write_sheet(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header, for a spreadsheet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
