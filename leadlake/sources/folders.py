"""Probes of whole folders: what each file is, by one distributed read of each kind, not file by file on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file's sample, characters of a text's preview.
SAMPLE, PREVIEW = 5, 500

_COLUMNS = ["file", "kind", "row_count", "columns", "sample"]


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Lines of the files with their places: the block's start, then the order in the task."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    return raw.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")


def _texts(spark: SparkSession, folder: str, pattern: str, kind: str) -> DataFrame:
    lines = _lines(spark, folder, pattern)
    g = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "place").alias("head"), F.min("place").alias("first"))
    # the few first lines: at most SAMPLE + 1 of each task and file
    from leadlake.operators.relational import first_of

    few = first_of(lines, ["file"], ["place"], SAMPLE + 1).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("few"))
    j = g.join(few, "file")
    if kind == "csv":
        return j.select("file", F.lit(kind).alias("kind"), (F.col("n") - 1).alias("row_count"), F.transform(F.split("head", ","), lambda c: F.trim(F.trim(c), F.lit('"'))).alias("columns"), F.slice("few", 2, SAMPLE).alias("sample"))
    none = F.array().cast("array<string>")
    return j.select("file", F.lit(kind).alias("kind"), F.col("n").alias("row_count"), none.alias("columns"), F.array(F.substring(F.array_join("few", "\n"), 1, PREVIEW)).alias("sample"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold one JSON list of objects, or one object: whole files, as the form wants."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    rows = F.from_json(F.when(F.startswith("v", F.lit("[")), F.col("v")).otherwise(F.concat(F.lit("["), "v", F.lit("]"))), "array<map<string,string>>")
    r = raw.select("file", F.coalesce(rows, F.array().cast("array<map<string,string>>")).alias("r"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("r", F.map_keys))))
    return r.select("file", F.lit("json").alias("kind"), F.size("r").cast("long").alias("row_count"), keys.alias("columns"), F.transform(F.slice("r", 1, SAMPLE), lambda m: F.to_json(m)).alias("sample"))


def probe_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each csv, txt, md or json file below folder: file (address), kind, row_count, columns, sample. Lines count as rows, a CSV's first one as its names;
    quoted line ends are not looked at. An empty file has no rows and is left out, but for json; other files are left out."""
    parts = [_texts(spark, folder, "*.csv", "csv"), _texts(spark, folder, "*.{txt,md}", "text"), _lists(spark, folder)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*_COLUMNS) for p in parts])


def probe_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, file (name), row_count and columns of each Parquet file of some tables (name -> path): counts come from the footers, one plan for all."""

    def one(name: str, path: str) -> DataFrame:
        df = spark.read.parquet(path)
        return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "file", "row_count", F.lit(len(df.columns)).alias("columns"))

    return reduce(lambda a, b: a.unionByName(b), [one(n, p) for n, p in paths.items()])
