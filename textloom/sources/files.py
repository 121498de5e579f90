"""Sources and sinks: lines, lexicons, gold tables, runs, idempotent and appending writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.text import split_words, tr_lower
from textloom.sources.scratch import hadoop_path

# Features that name a category rather than a suffix.
STRUCTURAL = ["V", "N", "ADJ", "ADV", "PRO", "DECL", "IND", "INTR", "POS", "NEG", "LGSPEC01", "LGSPEC02", "LGSPEC03", "LGSPEC04"]

GOLD_SCHEMA = "wordform string, stem string, lemma string, preceding_part string, following_part string, unique string, word_freq double"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table in one file with one row group is one task, however many cores wait.
    Tables of more parts than cores, all large ones, are left as they are. Rows
    may come in another order.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: trimmed lines that are not blank."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value")).filter(F.col("value") != "")


def read_articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Articles (a Parquet column ``text``) as lines: article (its number, also of equal texts), line_no, line."""
    articles = spark.read.schema("text string").parquet(path).withColumn("article", F.monotonically_increasing_id())
    articles = articles.orderBy("article").limit(limit) if limit else articles  # the first ones, in file order
    return articles.select("article", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_inflections(spark: SparkSession, path: str, single_word: bool = True, low: int = 3, high: int = 30) -> DataFrame:
    """lemma, inflected, features of a tab-separated gold file, with ``skipped`` (null if kept)."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = lines.select(F.trim(F.get(parts, F.lit(0))).alias("lemma"), F.trim(F.get(parts, F.lit(1))).alias("inflected"), F.trim(F.get(parts, F.lit(2))).alias("tags"), F.size(parts).alias("n"))
    features = F.filter(F.split("tags", ";"), lambda f: f != "")
    multi = F.col("lemma").contains(" ") | F.col("inflected").contains(" ")
    reason = F.when((F.col("n") < 3) | (F.col("tags") == ""), "incomplete").when(F.lit(single_word) & multi, "multiword").when(~F.length("inflected").between(low, high), "length")
    return rows.select("lemma", "inflected", features.alias("features"), reason.alias("skipped"))


def read_segmentation_gold(spark: SparkSession, path: str, longest: int = 30) -> DataFrame:
    """The rows of a gold CSV whose word is its stem plus parts, cleaned and distinct."""
    rows = spark.read.option("header", True).csv(path)
    for name, kind in (x.split(" ") for x in GOLD_SCHEMA.split(", ")):
        rows = rows.withColumn(name, F.col(name).cast(kind)) if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    word = F.col("wordform")
    kept = rows.filter(word.isNotNull() & F.col("stem").isNotNull() & (F.coalesce("unique", F.lit("unique")) == "unique") & (F.col("stem") == F.coalesce("lemma", "stem")))
    kept = kept.filter(~F.regexp_like(word, F.lit(r"[0-9]")) & ~F.regexp_like(word, F.lit(r"(?U)\s")) & F.length(word).between(2, longest))
    return kept.withColumn("word_freq", F.when(F.coalesce("word_freq", F.lit(0.0)) == 0, 1.0).otherwise(F.col("word_freq"))).dropDuplicates()


def read_questions(spark: SparkSession, path: str, question: str, choices: str) -> DataFrame:
    """text: each question and each choice, a row each."""
    rows = spark.read.parquet(path).select(F.explode(F.concat(F.array(question), F.coalesce(choices, F.array().cast("array<string>")))).alias("text"))
    return rows.filter("text is not null and text <> ''")


def read_lexicon(spark: SparkSession, path: str, both_cases: bool = False) -> DataFrame:
    """Distinct first words of a lexicon's lines in lower case (and as they are)."""
    first = F.get(split_words(F.col("value")), F.lit(0))
    lines = spark.read.text(path).select(first.alias("raw")).filter("raw is not null")
    forms = F.array("raw", tr_lower(F.col("raw"))) if both_cases else F.array(tr_lower(F.col("raw")))
    return lines.select(F.explode(forms).alias("word")).distinct()


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The morphemes and the words of a harvested inventory (one JSON object)."""
    data = spark.read.schema("morphemes array<string>, words array<string>").json(path, multiLine=True)
    return tuple(data.select(F.explode(c).alias("word")).distinct() for c in ("morphemes", "words"))


def read_tagged_sentences(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """sentence, pos, token, tag of (tokens, ner_tags) rows; sentences in hash order."""
    rows = spark.read.schema("tokens array<string>, ner_tags array<int>").parquet(path).withColumn("sentence", F.xxhash64("tokens", "ner_tags"))
    rows = rows.orderBy("sentence").limit(cap) if cap else rows
    return rows.select("sentence", F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x")).select("sentence", "pos", F.col("x.tokens").alias("token"), F.col("x.ner_tags").alias("tag"))


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All matching metric CSVs with ``run``, the name of their folder."""
    rows = spark.read.schema(schema).option("header", True).csv(glob)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def artifact_megabytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Total size of matching files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / (1024.0 * 1024.0)).alias("megabytes"))


def nearest_size(candidates: DataFrame, preferred: int) -> DataFrame:
    """kind, path of the candidate (kind, path, size) whose size is nearest."""
    return candidates.groupBy("kind").agg(F.min_by("path", F.struct(F.abs(F.col("size") - preferred), "path")).alias("path"))


def files_of(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modified of matching files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def preferred_file(files: DataFrame, preferred: list[str]) -> DataFrame:
    """path of the first of the preferred names that is there, else of the newest file; no row without files."""
    at = F.array_position(F.array(*map(F.lit, preferred)).cast("array<string>"), F.col("name"))
    place = F.when(at > 0, at).otherwise(len(preferred) + 1)
    return files.orderBy(place, F.desc("modified"), "path").limit(1).select("path")


def ingest_once(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a text file or folder, unless the target already has as many bytes; whether it was copied."""
    (one, files_of_one), (two, files_of_two) = hadoop_path(spark, source), hadoop_path(spark, target)
    size = files_of_one.getContentSummary(one).getLength()
    if files_of_two.exists(two) and files_of_two.getContentSummary(two).getLength() == size:
        return False
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(files_of_one, one, files_of_two, two, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return True


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def write_token_lines(encoded: DataFrame, path: str) -> DataFrame:
    """One line of blank-separated ids a document, in ascending doc_id, from doc_id, pos, sub, id rows.

    Lines follow the order of the part files. Returns documents, tokens and
    distinct ids of what was written, in one row.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "id"))), lambda x: x["id"].cast("string"))
    lines = encoded.groupBy("doc_id").agg(F.array_join(ids, " ").alias("value"))
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    found = encoded.sparkSession.read.text(path).select(F.split("value", " ").alias("ids"))
    counts = found.select(F.explode("ids").alias("id")).filter("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct_ids")).crossJoin(found.agg(F.count(F.lit(1)).alias("documents")))  # one row each


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is left alone if it is there: a repeated ingest does nothing."""
    df.write.mode("ignore").parquet(path)


def append_with_backup(df: DataFrame, path: str, backup: str) -> None:
    """Append to a Parquet table; the first time, its rows are kept at ``backup``."""
    spark = df.sparkSession
    spark.read.parquet(path).write.mode("ignore").parquet(backup)
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one CSV (with header) or JSON file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
