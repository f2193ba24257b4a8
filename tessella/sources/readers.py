"""Readers and writers; every table has an explicit schema."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.functions import lm_events


def read_csv_strings(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """CSV with a header, all columns text; an empty field is null."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and typed columns; fields that do not parse are null."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a fixed list of fields; nulls are empty."""
    df.select(*[F.col(f).cast("string").alias(f) for f in fields]).na.fill("").write.csv(path, header=True, escape='"', emptyValue="")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or for a path that ends in .json a JSON array (not splittable)."""
    reader = spark.read.schema(schema)
    return reader.option("multiLine", True).json(path) if path.rstrip("/").endswith(".json") else reader.json(path)


def write_jsonl(df: DataFrame, path: str, tokens: str | None = None) -> dict:
    """JSON lines; returns rows and the sum and maximum of ``tokens``, gathered while writing."""
    seen = Observation()
    value = F.col(tokens) if tokens else F.lit(0)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(value).alias("tokens"), F.max(value).alias("max_tokens")).write.json(path)
    return seen.get


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines partitioned by keys; each partition's rows are gathered, a large one over several files."""
    df.repartition(*keys, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(8))).write.partitionBy(*keys).json(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Valid rows without the error column, and the rows with an error."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    """Raise if a required column is missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_same_columns(df: DataFrame, other: DataFrame) -> None:
    """Raise unless both tables have the same columns of the same types in one order."""
    if df.dtypes != other.dtypes:
        apart = [f"{a} / {b}" for a, b in zip_longest(df.dtypes, other.dtypes) if a != b]
        raise ValueError(f"columns differ: {'; '.join(apart)}")


def aligned_to(df: DataFrame, other: DataFrame, derived: dict | None = None) -> DataFrame:
    """Columns of ``other`` from ``df``: its own, else derived ones, else null."""
    derived = derived or {}
    return df.select(*[(derived[f.name] if f.name in derived else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in other.schema])


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Event files of four tab-separated columns: path, pos, event, value, duration, offset, error.

    Comment and blank lines go; rows that break the grammar keep their text and
    carry the error.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return event_rows(whole, ["path"], "value")


def event_rows(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows of event texts, validated."""
    lines = texts.select(*key, F.posexplode(F.split(text, "\r?\n", -1)).alias("pos", "line")).where("trim(line) <> '' AND NOT line LIKE '#%'")
    parts = lines.withColumn("c", F.split("line", "\t", -1))
    cells = [F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("event", "value", "duration", "offset"))]
    rows = parts.select(*key, "pos", F.size("c").alias("_n"), *cells)
    error = F.when(F.col("_n") != 4, "not four columns").otherwise(lm_events.row_error(*[F.col(c) for c in ("event", "value", "duration", "offset")]))
    return rows.withColumn("error", error).drop("_n")


def skip_existing(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks whose output is not there yet."""
    return tasks.join(done.select(*key), key, "left_anti")


def first_existing(tasks: DataFrame, key: str, candidates: list[str], manifest: DataFrame) -> DataFrame:
    """Add ``resolved``: the first of the candidate path columns that the manifest (path) holds."""
    long = tasks.select(key, F.posexplode(F.array(*candidates)).alias("_rank", "path")).join(manifest.select("path").distinct(), "path", "left_semi")
    best = long.groupBy(key).agg(F.min(F.struct("_rank", "path")).alias("_b")).select(key, F.col("_b.path").alias("resolved"))
    return tasks.join(best, key, "left")


def newest_variant(df: DataFrame, key: str, priority: str, name: str) -> DataFrame:
    """One row per key: the highest priority, then the last name."""
    order = W.partitionBy(key).orderBy(F.col(priority).desc(), F.col(name).desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def discover(spark: SparkSession, folder: str, pattern: str = "*", rewrite: tuple[str, str] | None = None, variants: str | None = None) -> DataFrame:
    """Files below ``folder`` whose name matches the glob ``pattern``: path, name, stem, variant, length, modified.

    Only the listing is read, not the contents. ``stem`` is the name without its
    extension, after ``rewrite`` (pattern, replacement); ``variant`` is what
    ``variants`` (a pattern) finds at the end of the stem, which then goes, so
    that a file and its variants share a stem. Hidden files are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = stem if rewrite is None else F.regexp_replace(stem, *rewrite)
    variant = F.lit("") if variants is None else F.regexp_extract(stem, f"({variants})$", 1)
    return listed.select("path", name.alias("name"), F.substring(stem, F.lit(1), F.length(stem) - F.length(variant)).alias("stem"), variant.alias("variant"), "length", "modified")


def inventory(files: DataFrame, group: list[Column]) -> DataFrame:
    """Files and bytes by ``group`` (of the columns of ``discover``)."""
    return files.groupBy(*group).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """Write whole lines unchanged, in order over the files: a filter of a file of lines keeps their bytes."""
    df.orderBy(*order).select(line).write.text(path)


def write_json_array(df: DataFrame, order: list[str], path: str) -> None:
    """One JSON array over the part files of ``path``: an element a line, brackets in files before and after them.

    Read in the order of their names the files are one array, as one document;
    no task holds it. ``order`` must tell all rows apart.
    """
    spark = df.sparkSession
    row = F.to_json(F.struct(*df.columns))
    # A separator precedes every element but the first, which is the least row.
    first = df.agg(F.min(F.struct(*order)).alias("f")).first()["f"]
    least = F.lit(True)
    for name, value in zip(order, first or ()):
        least = least & F.col(name).eqNullSafe(F.lit(value))
    df.orderBy(*order).select(F.concat(F.when(least, "").otherwise(","), row).alias("value")).write.text(path)
    for name, bracket in (("part-!open", "["), ("part-~close", "]")):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.txt")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(bracket.encode()))
        out.close()
