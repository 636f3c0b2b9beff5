"""Reading exports and keeping tables: scans, upserts, replacement, batches that land whole or not at all."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The first of UTF-8, GB18030 and ISO-8859-1 in which every line of the files can be read.

    Lines are tested as bytes where Spark reads them, so a large file is tested in parts; only lines that are no UTF-8 meet Python."""

    @F.pandas_udf("boolean")
    def readable(lines: pd.Series) -> pd.Series:
        def test(line: bytes) -> bool:
            try:
                return bool(bytes(line).decode("gb18030")) or True
            except UnicodeDecodeError:
                return False

        return lines.map(test).astype(bool)

    other = spark.read.text(path).where(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("line"))
    if other.isEmpty():
        return "UTF-8"
    return "GB18030" if other.where(~readable("line")).isEmpty() else "ISO-8859-1"


def read_export(spark: SparkSession, path: str, kind: str = "csv", encoding: str | None = "UTF-8", multi_line: bool = True) -> DataFrame:
    """An export with every column as text. ``kind``: csv, tsv, jsonl or json (one document, rows perhaps inside an envelope).

    A cell may hold line breaks; with ``multi_line`` false it may not, and Spark splits a large file over tasks. ``encoding`` None:
    probed. A byte order mark before the first header is dropped. Spark reads GB18030 only with ``spark.sql.legacy.javaCharsets``,
    which is set on the session then."""
    if kind in ("csv", "tsv"):
        encoding = encoding or probe_encoding(spark, path)
        if encoding.upper() == "GB18030":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.csv(path, header=True, inferSchema=False, sep="\t" if kind == "tsv" else ",", mode="PERMISSIVE", encoding=encoding, multiLine=multi_line, escape='"')
        return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    df = spark.read.json(path, multiLine=kind == "json")
    for name in ("data", "results", "items", "products", "records"):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            df = df.select(F.explode(name).alias("_r")).select("_r.*")
            break
    return flatten(df)


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns, lists as JSON, all as text."""
    cols = []

    def walk(prefix, field):
        kind, at = field.dataType, f"{prefix}`{field.name}`"
        if kind.typeName() == "struct":
            for f in kind.fields:
                walk(f"{at}.", f)
        else:
            c = F.col(at)
            cols.append((F.to_json(c) if kind.typeName() in ("array", "map") else c.cast("string")).alias(at.replace("`", "")))

    for f in df.schema.fields:
        walk("", f)
    return df.select(*cols)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of the keys in ``new`` replaced; columns that one side lacks are null there."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_owned(old: DataFrame, new: DataFrame, key: str, owner: str, values: list[str]) -> DataFrame:
    """Upsert that leaves rows alone which another owner holds; ``conflict`` marks them."""
    o = old.select(key, F.col(owner).alias("_oo"), *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_in"))
    n = new.select(key, F.col(owner).alias("_no"), *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_is"))
    j = o.join(n, key, "full_outer")
    theirs = F.coalesce(F.col("_in") & F.col("_is") & (F.col("_oo") != F.col("_no")), F.lit(False))
    keep = F.col("_is").isNull() | theirs
    return j.select(key, F.coalesce("_oo", "_no").alias(owner), *[F.when(keep, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in values], theirs.alias("conflict"))


def guard_formulas(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run as formulas get a quote in front."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def write_curated(df: DataFrame, path: str, market: str) -> None:
    """Replaces one market of a table and leaves the others."""
    df.withColumn("market", F.lit(market)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market").parquet(path)


def read_curated(spark: SparkSession, path: str, market: str | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.where(F.col("market") == market) if market else df


class Batch:
    """Several tables that become visible together: each is written to its own run folder, then one manifest names them all.

    The manifest is written as a small Parquet table through Spark, so it works on any file system that Spark writes to. A commit
    adds one row with its own tables only, and readers put all rows together, newer ones over older ones (of one version, by run).
    So of two commits at once neither hides the other's tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.run, self.tables = spark, root.rstrip("/"), uuid.uuid4().hex, {}

    def write(self, name: str, df: DataFrame) -> None:
        path = f"{self.root}/_runs/{self.run}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.tables[name] = path

    def commit(self) -> None:
        seen = latest_manifest(self.spark, self.root)
        row = (int(seen["version"]) + 1 if seen else 1, self.run, json.dumps(self.tables))
        self.spark.createDataFrame([row], "version long, run string, tables string").coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")


def latest_manifest(spark: SparkSession, root: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    commits, tables = sorted(tuple(r) for r in spark.read.parquet(f"{root}/_manifest").select("version", "run", "tables").collect()), {}
    for _, _, own in commits:
        tables |= json.loads(own)
    return {"version": commits[-1][0], "tables": tables} if commits else None


def read_batch(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = latest_manifest(spark, root)
    if not found or name not in found["tables"]:
        raise KeyError(name)
    return spark.read.parquet(found["tables"][name])


class Registry:
    """Runs of datasets as an append-only table of their states: running, then success or failed.

    A run that ended writes a second row; nothing is updated, so writers never meet. ``runs`` puts the rows together."""

    SCHEMA = "dataset string, run string, state string, at timestamp_ntz, note string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/runs"

    def record(self, states: DataFrame) -> None:
        states.select("dataset", "run", "state", "at", "note").write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        """dataset, run, version (1 for the first run of a dataset), started, completed, status, note of the last state."""
        rows, ended = self.spark.read.schema(self.SCHEMA).parquet(self.path), F.col("state") != "running"
        last = F.struct(ended.cast("int"), "at", "state")
        g = rows.groupBy("dataset", "run").agg(F.min(F.when(~ended, F.col("at"))).alias("started"), F.max(F.when(ended, F.col("at"))).alias("completed"), F.max_by("state", last).alias("status"), F.max_by("note", last).alias("note"))
        version = F.row_number().over(W.partitionBy("dataset").orderBy(F.col("started").asc_nulls_last(), "run"))
        return g.select("dataset", "run", version.alias("version"), "started", "completed", "status", "note")


def upload_conflicts(uploads: DataFrame, content: str, key: str, market: str, period: str) -> DataFrame:
    """(hash, copies, markets, first, conflict): contents that were uploaded more than once; ``conflict`` where they stand under
    different markets or periods (null is a value of its own)."""
    place = F.struct(F.col(market).isNull(), market, F.col(period).isNull(), period)
    g = uploads.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(market).alias("markets"), F.min(key).alias("first"), (F.min(place) != F.max(place)).alias("conflict"))
    return g.where(F.col("hash").isNotNull() & (F.col("copies") > 1))
