"""Folds, predictions, summaries and result tables on storage."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from anchorgrid.operators.ordered import attach_row

FOLD_COLUMNS = {"context", "word", "label"}
FOLD_SPLITS = {"train", "validation", "test"}
PREDICTION_SCHEMA = (
    "model string, fold int, sample_id string, group_id string, label int, logit double, "
    "probability double, threshold double, prediction int"
)


class SourceError(ValueError):
    """A stored table does not have the layout its reader needs."""


def check_fold(df: DataFrame, columns: set[str] = FOLD_COLUMNS) -> DataFrame:
    """Fail unless the required columns and all three splits are there."""
    missing = columns - set(df.columns)
    if missing:
        raise SourceError(f"fold lacks columns {sorted(missing)}")
    splits = {r[0] for r in df.select("split").where(F.col("split").isin(sorted(FOLD_SPLITS))).distinct().collect()}  # three rows at most
    if not FOLD_SPLITS <= splits:
        raise SourceError(f"fold lacks splits {sorted(FOLD_SPLITS - splits)}")
    return df


def load_fold(spark: SparkSession, path: str, columns: set[str] = FOLD_COLUMNS) -> DataFrame:
    return check_fold(spark.read.parquet(path), columns)


#: Split and fold of a stored file, from its folder (``split=train``, ``train/``) or its name (``train-00000.parquet``).
SPLIT_IN_PATH = r"/(?:split=)?(train|validation|test)(?=[-/.])"
FOLD_IN_PATH = r"/fold[=-]([0-9]+)/"


def load_fold_dataset(spark: SparkSession, dataset: str, columns: set[str] = FOLD_COLUMNS) -> DataFrame:
    """The fold rows that ``dataset`` names: a table of the catalog, else a folder of Parquet files at any depth.

    A file without a split or fold column takes them from its path. What is neither, lacks a required column or one of the
    splits is an error.
    """
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", dataset) and spark.catalog.tableExists(dataset):
        return check_fold(spark.table(dataset), columns)
    try:
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(dataset)
    except AnalysisException as error:
        raise SourceError(f"{dataset} is neither a table nor a folder of Parquet files") from error
    path = F.col("_metadata.file_path")
    found = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    if "split" not in rows.columns:
        rows = rows.withColumn("split", found(SPLIT_IN_PATH))
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", found(FOLD_IN_PATH).try_cast("int"))
    return check_fold(rows, columns)


def write_folds(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One partition per (fold, split); only the partitions that are written get replaced.

    The hash column spreads a split over as many tasks as it needs files. The counts are one row with an entry per
    (fold, split), which are the folders written.
    """
    key = F.struct("fold", "split")
    parts = F.ceil(F.count(F.lit(1)) / rows_per_file).cast("long")
    sizes = df.groupBy("fold", "split").agg(parts.alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("__parts"))
    spread = F.xxhash64(*[c for c, t in df.dtypes if t in ("string", "bigint", "int")])
    salted = attach_row(df, sizes).withColumn("__salt", F.pmod(spread, F.coalesce(F.try_element_at("__parts", key), F.lit(1)))).drop("__parts")
    (
        salted.repartition("fold", "split", "__salt").drop("__salt")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file).partitionBy("fold", "split").parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a malformed line or an empty set of files is an error."""
    df = spark.read.schema(PREDICTION_SCHEMA).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise SourceError(f"no prediction rows in {path}")
    return df


def write_json_lines(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").json(path)


def bad_json_lines(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """(file, line_no, line) of lines that do not parse, for the error report of a failed read.

    Line numbers are positions inside one file, so a file is the unit of work here.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parsed = F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.filter((F.trim("line") != "") & parsed["_bad"].isNotNull()).select(
        "file", (F.col("pos") + 1).alias("line_no"), "line"
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null, inside arrays and structs too."""

    def safe(column, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bad = F.isnan(column) | (F.abs(column) == float("inf"))
            return F.when(~bad, column)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: safe(x, kind.elementType))
        if isinstance(kind, T.StructType):
            fields = [safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(column.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda _, v: safe(v, kind.valueType))
        return column

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables with the union of their columns; nested cells as JSON text."""
    out = None
    for table in tables:
        table = json_safe(table)
        flat = [
            (F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
             else F.col(f"`{f.name}`")).alias(f.name)
            for f in table.schema.fields
        ]
        table = table.select(*flat)
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    union_tables([df]).write.mode("overwrite").option("header", True).csv(path)


# fixed values: columns of the metric summary
METRIC_SUMMARY = ("split", "metric", "num_folds", "num_valid_folds", "mean", "standard_deviation", "standard_error", "median", "minimum", "maximum")
METRIC = "struct<mean:double,num_valid_folds:int>"
SUMMARY_SCHEMA = (
    f"fold_statistics struct<validation:map<string,{METRIC}>,test:map<string,{METRIC}>>, "
    "folds map<string,struct<test_metrics:map<string,double>,validation_metrics:map<string,double>,"
    "decision_threshold:double,run_name:string>>"
)
# fixed values: <model>/<family>[/<variant>..]/cross_validation_seed-<n>/<name>_cross_validation_summary.json
SUMMARY_PATH = (
    r"([^/]+)/((?:target|tgt)-[^/]+)(?:/(.+?))?/cross_validation_seed-([0-9]+)/[^/]*$"
)
SUMMARY_FILES = "{*_cross_validation_summary.json,part-*}"


def plain_path(path: Column) -> Column:
    """A path with ``name=value`` folders, as Spark writes them, in the layout of plain folders."""
    for pattern, put in ((r"/(?:model|family|variant)=", "/"), (r"/__HIVE_DEFAULT_PARTITION__(?=/)", ""), (r"/seed=", "/cross_validation_seed-")):
        path = F.regexp_replace(path, pattern, put)
    return path


def parse_summaries(files: DataFrame) -> DataFrame:
    """(path, text) of summary files -> model, family, variant, seed and the parsed summary."""
    part = lambda i: F.when(F.regexp_extract("path", SUMMARY_PATH, i) != "", F.regexp_extract("path", SUMMARY_PATH, i))
    parsed = files.select(
        "path", part(1).alias("model"), part(2).alias("family"), part(3).alias("variant"),
        part(4).try_cast("bigint").alias("seed"), F.from_json("text", SUMMARY_SCHEMA).alias("summary"),
    )
    issue = F.when(F.col("model").isNull(), "unexpected path").when(
        F.col("summary.fold_statistics").isNull() | F.col("summary.folds").isNull(), "not a summary"
    )
    return parsed.withColumn("issue", issue)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", SUMMARY_FILES).text(path, wholetext=True)
    )
    return parse_summaries(text.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))


def write_summaries(df: DataFrame, path: str) -> None:
    """model, family, variant, seed and summary as one JSON file per run below folders of these names.

    A run is one row; a null variant has no folder of its own when read back.
    """
    rows = json_safe(df).select("model", "family", "variant", "seed", F.to_json("summary").alias("value"))
    rows.repartition("model", "family", "variant", "seed").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("model", "family", "variant", "seed").text(path)


def write_metric_summary(statistics: DataFrame, path: str) -> None:
    """Split, metric and its statistics over folds as CSV."""
    write_csv(statistics.select(*METRIC_SUMMARY), path)


def summary_metrics(summaries: DataFrame, split: str = "test") -> DataFrame:
    """One row per (model, family, variant, seed, metric)."""
    return summaries.filter(F.col("issue").isNull()).select(
        "model", "family", "variant", "seed",
        F.explode(F.col(f"summary.fold_statistics.{split}")).alias("metric", "s"),
    ).select("model", "family", "variant", "seed", "metric", "s.mean", "s.num_valid_folds")
