"""JSON lines: strict reads under a schema, and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators.claims import ANSWER
from citeloom.operators.judge import VERDICTS
from citeloom.operators.report import MODES

QUESTION = "id string, text string, failure_modes array<string>, domain string, notes string, aspects array<string>"
LABEL = "claim_id string, verdict string, labeler string, rationale string"
DOCUMENT = "url string, title string, text string"
PAGE = "url string, title string, raw string"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, line, ord)``: lines with their number in their file and their order over all files, by file name.

    Lines are counted per split first; a line's number is its place in the split plus the lines of the splits before.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    upto = lambda w: F.sum("n").over(w) - F.col("n")
    placed = splits.select("file", "start", "first", upto(Window.partitionBy("file").orderBy("start")).alias("above"), upto(Window.partitionBy(F.lit(0)).orderBy("file", "start")).alias("before"))  # a row per split
    at = F.col("id") - F.col("first")
    return read.join(placed, ["file", "start"]).select("value", "file", (at + F.col("above") + 1).alias("line"), (at + F.col("before")).alias("ord"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file or folder of JSON lines, with ``ord`` in file order; a missing path is empty, blank lines are
    skipped, broken lines raise with file, line number and text."""
    empty = spark.createDataFrame([], f"ord long, {schema}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    lines = _numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not JSON: "), "value"))
    sound = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), broken).otherwise(F.col("r"))  # whoever reads a field raises first
    return parsed.select("ord", sound.alias("r")).select("ord", "r.*").drop("_bad")


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> int:
    """Overwrite ``path`` with the rows as JSON lines; the number of rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def _must(df: DataFrame, condition, message: str) -> DataFrame:
    return df.withColumn("__ok", F.when(condition, True).otherwise(F.raise_error(F.lit(message)))).where("__ok").drop("__ok")


def questions(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Questions with defaults; blank texts, no modes and unknown modes raise."""
    df = read_jsonl(spark, path, QUESTION)
    if required and df.isEmpty():
        raise ValueError(f"no questions at {path}")
    df = df.withColumns({"domain": F.coalesce("domain", F.lit("general")), "notes": F.coalesce("notes", F.lit("")), "aspects": F.coalesce("aspects", F.array().cast("array<string>"))})
    df = _must(df, F.trim(F.coalesce("text", F.lit(""))) != "", "question text must not be blank")
    return _must(df, (F.size("failure_modes") > 0) & F.forall("failure_modes", lambda m: m.isin(MODES)), "question needs known failure modes")


def labels(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, LABEL).withColumn("rationale", F.coalesce("rationale", F.lit("")))
    return _must(df, F.col("verdict").isin(VERDICTS) & F.col("claim_id").isNotNull() & F.col("labeler").isNotNull(), "label needs a claim, a labeler and a known verdict")


def answers(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    df = read_jsonl(spark, path, ANSWER)
    if required and df.isEmpty():
        raise ValueError(f"no answers at {path}")
    return df


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, DOCUMENT).withColumn("title", F.coalesce("title", F.lit(""))).withColumnRenamed("ord", "doc_index")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PAGE)


def merge_labels(existing: DataFrame, new: DataFrame, path: str) -> None:
    """Existing and new labels to ``path``, through a staging folder beside it, since Spark cannot overwrite what it reads."""
    rows = existing.select("claim_id", "verdict", "labeler", "rationale").unionByName(new.select("claim_id", "verdict", "labeler", "rationale"))
    spark, tmp = rows.sparkSession, path.rstrip("/") + ".next"
    rows.write.mode("overwrite").json(tmp)
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    store, old, new = (jvm.Path(p) for p in (path, path.rstrip("/") + ".old", tmp))
    fs = store.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(store):  # the old store stays, under a name of its own, until the new one is in place
        fs.rename(store, old)
    fs.rename(new, store)
    fs.delete(old, True)


def verdict_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted ``(claim_id, verdict, rationale)``, rejected ``(claim_id, verdict)``) of a JSON map of verdicts.

    Values are ``[verdict, rationale]`` or a bare verdict.
    """
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("claim_id", "v"))
    listed = F.from_json("v", "array<string>")
    rows = each.select("claim_id", F.lower(F.trim(F.coalesce(listed[0], F.col("v")))).alias("verdict"), F.coalesce(F.get(listed, F.lit(1)), F.lit("")).alias("rationale"))
    good = F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))
    return rows.where(good), rows.where(~good).select("claim_id", "verdict")
