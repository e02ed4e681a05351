"""Readers and writers of text formats, snapshots and keyed files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the one that driver and executors share, as spark.checkpoint.dir names it; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/graintable-work"
    return f"{base.rstrip('/')}/graintable/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to a new folder and read back, so that all later reads see the same rows and no executor's loss costs more than its tasks."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Successive:
    """A table that is replaced round by round: each version is written and read back, then the one before goes, so a long run doesn't fill the shared folder."""

    def __init__(self, tag: str):
        self.tag, self.path = tag, ""

    def put(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = work_path(spark, self.tag)
        df.write.parquet(self.path)
        if old:
            remove(spark, old)
        return spark.read.schema(df.schema).parquet(self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of working files wherever Spark can write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and unparsable ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """As read_jsonl, and an observation that has `lines` (blank ones aside) and `unparsable` once a job has read the frame whole: no second scan counts them."""
    seen = Observation()
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.observe(seen, F.count("*").alias("lines"), F.count("_broken").alias("unparsable")).where("_broken is null").drop("_broken"), seen


def with_counts(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df and an observation that has the counts (aggregates over df's columns) once a job has gone through it, such as changed rows of a patch or rejected ones of a split."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


#: A cell of a CSV line: quoted with doubled quotes, or up to the next comma.
CELL = r'(?:^|,)\s*(?:"((?:[^"]|"")*)"|([^,"]*))\s*(?=,|$)'


def cells(line: Column) -> Column:
    """The cells of a CSV line, trimmed and unquoted."""
    quoted, bare = F.regexp_extract_all(line, F.lit(CELL), F.lit(1)), F.regexp_extract_all(line, F.lit(CELL), F.lit(2))
    return F.zip_with(quoted, bare, lambda q, b: F.when(q != "", F.regexp_replace(q, '""', '"')).otherwise(F.trim(b)))


def read_with_header_probe(spark: SparkSession, path: str, key: str, max_rows: int = 15) -> DataFrame:
    """CSV files whose header is the first of max_rows lines with a cell equal to key; lines up to it are skipped in each file, all columns are text.

    Headers may stand in different lines but have the same names in the same order. Lines are numbered from each file's start, where its
    first block is read; rows are parsed in parallel. A file without a header is an error.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    starts = lines.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    numbered = lines.join(starts, "_file").withColumn("_n", F.when(F.col("_block") == 0, F.col("_at") - F.col("_first")).otherwise(max_rows))
    heads = (numbered.where(F.col("_n") < max_rows).where(F.array_contains(cells(F.col("value")), key))
             .groupBy("_file").agg(F.min(F.struct("_n", "value")).alias("_head")).select("_file", F.col("_head._n").alias("_line"), F.col("_head.value").alias("_names")))
    seen = starts.join(heads, "_file", "left").agg(F.count("*").alias("files"), F.count("_line").alias("with_header"), F.min(cells(F.col("_names"))).alias("names"), F.max(cells(F.col("_names"))).alias("others")).first()
    if not seen["files"] or seen["files"] != seen["with_header"]:
        raise ValueError(f"no header with {key} in the first {max_rows} rows")
    if seen["names"] != seen["others"]:
        raise ValueError("the files' headers differ")
    schema = ", ".join(f"`{n}` string" for n in seen["names"])
    rows = numbered.join(heads.select("_file", "_line"), "_file").where((F.col("_n") > F.col("_line")) & (F.col("value") != ""))
    return rows.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")


def read_latest(spark: SparkSession, pattern: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the path with the greatest name among those that match a pattern; path listings, not rows, are compared."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in (fs.globStatus(hadoop) or []))
    if not found:
        raise FileNotFoundError(pattern)
    return spark.read.format(fmt).load(found[-1])


def write_corpus(df: DataFrame, path: str, key: str, text: str, *folders: str) -> None:
    """A file a row, in folders named by folders and key, written by Spark's tasks; the file ends with a line end of its own. For fixtures: a folder a row suits no large table, which write_packs() takes."""
    df.select(*folders, F.col(key), F.col(text).alias("value")).write.partitionBy(*folders, key).text(path)


def read_corpus(spark: SparkSession, path: str, pattern: str | None = None, ended: bool = False) -> DataFrame:
    """stem, text: one row a text file in any folder below path, keyed by its name without the extension, or by group 1 of a pattern in its path.

    ended: files end with a line end that isn't the text's, as write_corpus() leaves them.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    stem = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "") if pattern is None else F.regexp_extract("_metadata.file_path", pattern, 1)
    text = F.expr("substring(value, 1, length(value) - 1)") if ended else F.col("value")
    return files.select(stem.alias("stem"), text.alias("text"))


#: Folder names that would come back as null; they get one more underscore.
NO_NAME = "^(__HIVE_DEFAULT_PARTITION__)?_*$"


def write_packs(df: DataFrame, path: str, key: str, text: str, *folders: str) -> None:
    """Whole texts in files that hold many, a JSON line each with its stem, in folders named by folders: as many files as tasks and folders, so their number doesn't grow with the rows."""
    named = [F.when(F.col(c).cast("string").rlike(NO_NAME), F.concat(F.col(c).cast("string"), F.lit("_"))).otherwise(F.col(c).cast("string")).alias(c) for c in folders]
    df.select(*named, F.col(key).cast("string").alias("stem"), F.col(text).alias("text")).write.partitionBy(*folders).option("ignoreNullFields", True).json(path)


def read_packs(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """stem, text and the folders' names, all strings, of texts written by write_packs(); null texts and folders come back as null, empty texts as empty."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in ("stem", "text", *folders))).option("mode", "FAILFAST").json(path)
    return rows.select("stem", "text", *[F.when(F.col(c).rlike(NO_NAME), F.expr(f"substring(`{c}`, 1, length(`{c}`) - 1)")).otherwise(F.col(c)).alias(c) for c in folders])


def read_keyed_files(spark: SparkSession, path: str, schema: str, pattern: str, key: str) -> DataFrame:
    """CSV files in one table; key is group 1 of the pattern in each file's path."""
    return spark.read.schema(schema).option("header", True).csv(path).select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(key), "*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_flat_csv(df: DataFrame, path: str, sep: str = "|") -> None:
    """CSV with a header; array columns are joined by sep."""
    flat = [F.array_join(f.name, sep).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def versions(spark: SparkSession, table_path: str) -> DataFrame:
    """n, version of every version that was switched to; none for a table without any."""
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_path}/_pointer")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return spark.createDataFrame([], "n long, version string")
    return spark.read.schema("n long, version string").json(f"{table_path}/_pointer")


def overwrite_atomic(df: DataFrame, table_path: str) -> str:
    """Write a new version beside the others, then switch the pointer to it by number; readers of current() see the old or the new whole. Returns the version."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table_path}/{version}")
    n = versions(spark, table_path).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"] + 1
    spark.createDataFrame([(n, version)], "n long, version string").coalesce(1).write.mode("append").json(f"{table_path}/_pointer")
    return version


def current(spark: SparkSession, table_path: str) -> DataFrame:
    """The version with the greatest number; of two writers that took the same number, the one with the greater name."""
    last = versions(spark, table_path).orderBy(F.desc("n"), F.desc("version")).first()
    return spark.read.parquet(f"{table_path}/{last['version']}")


def snapshot(df: DataFrame, path: str, tag: str) -> None:
    """Keep df under tag=<tag> before a destructive change; a tag that exists is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/tag={tag}")


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder a value of key, CSV with a header."""
    df.write.partitionBy(key).option("header", True).csv(path)


def split_rejects(df: DataFrame, keep: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rejected rows with reason; null counts as reject."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", reason)


def write_quality_split(df: DataFrame, gate: Column, path: str) -> None:
    """path/full has all rows, path/quality those that pass the gate; df is computed once."""
    df.write.parquet(f"{path}/full")
    spark = df.sparkSession
    spark.read.schema(df.schema).parquet(f"{path}/full").where(F.coalesce(gate, F.lit(False))).write.parquet(f"{path}/quality")

