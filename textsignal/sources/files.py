"""File sources and sinks.

All scans are lazy Spark readers; the only driver-side work is listing paths and
reading schemas (metadata), never rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, NumericType, StringType, StructField, StructType

from textsignal.functions.schema import SUPPORTED_SUFFIXES, normalize_columns


UTF8 = ("UTF-8", "UTF8")
ENCODINGS = ("UTF-8", "ISO-8859-1")


def file_encodings(spark: SparkSession, path: str | list[str], encodings: Sequence[str]) -> dict[str, str | list[str]]:
    """The files of a path by encoding.  Every byte of every line counts (header, all columns, all rows): one
    aggregate over the raw lines tells which files aren't valid UTF-8.  Those take the next encoding; without
    one they are an error.  Only file names reach the driver."""
    if encodings[0].upper().replace("_", "-") not in UTF8:
        return {encodings[0]: path}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    files = lines.groupBy("file").agg(F.count_if(~F.col("valid")).alias("broken")).collect()
    bad = [unquote(r["file"]) for r in files if r["broken"]]
    if not bad:
        return {encodings[0]: path}
    if len(encodings) < 2:
        raise ValueError(f"not valid {encodings[0]}: {', '.join(bad)}")
    good = [unquote(r["file"]) for r in files if not r["broken"]]
    return {encodings[1]: bad} | ({encodings[0]: good} if good else {})


def _wider(a: DataType, b: DataType) -> DataType:
    """The type that holds both: equal types, doubles for different numbers, else text."""
    if a == b:
        return a
    return DoubleType() if isinstance(a, NumericType) and isinstance(b, NumericType) else StringType()


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
             encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """S1 + S2: CSV with header; declared schema if given (inference only for profiling).

    The encoding is decided per file (``file_encodings``), with one reader per encoding and their union by name; inferred
    types of the readers are joined to the wider one.  A BOM on the first header is stripped."""
    reader = lambda e: spark.read.option("header", True).option("encoding", e).option("mode", "PERMISSIVE")
    groups = file_encodings(spark, path, encodings)
    schemas = {e: schema for e in groups}
    if schema is None:
        found = {e: reader(e).option("inferSchema", True).csv(p).schema for e, p in groups.items()}
        types: dict[str, DataType] = {}
        for f in (f for s in found.values() for f in s):
            name = f.name.lstrip("\ufeff")
            types[name] = _wider(types[name], f.dataType) if name in types else f.dataType
        schemas = {e: StructType([StructField(f.name, types[f.name.lstrip("\ufeff")]) for f in s]) for e, s in found.items()}
    frames = [reader(e).schema(schemas[e]).csv(p) for e, p in groups.items()]
    frames = [df.toDF(*[c.lstrip("\ufeff") for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str | list[str], fmt: str, schema: StructType | str,
                 encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """S8 inside files: (good rows, error rows).  A record that doesn't fit the schema is routed, with its file and its text,
    to the error rows (file, record, error); the good rows have the declared columns only."""
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*declared.fields, StructField(CORRUPT, StringType())])
    r = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = r.option("header", True).option("encoding", encoding).csv(path) if fmt == "csv" else r.json(path)
    names = declared.names
    read = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})     # all columns are read: the parser then sees every error
    bad = df.select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("record"),
                    F.concat(F.lit("malformed record, read as "), read).alias("error")).where(
        F.col("record").isNotNull() & F.col("error").isNotNull())
    held = df.select("*", read.alias("_read")).where(F.col(CORRUPT).isNull() & F.col("_read").isNotNull())
    return held.select(*names), bad


def json_layout(spark: SparkSession, path: str) -> str:
    """``lines`` if every non-blank line is an object of its own, ``documents`` if every file is one document (an array, or an
    object over several lines), ``damaged`` if there are object lines among others, else ``none``."""
    is_object = F.json_object_keys("value").isNotNull()
    lines = spark.read.text(path).filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_object).alias("objects")).first()
    if lines["n"] == lines["objects"]:
        return "lines"
    # a document is an array, or an object that is not complete in its first line
    head = F.regexp_extract("value", r"^\s*(\S[^\n]*)", 1)
    array = F.startswith(head, F.lit("[")) & F.json_array_length("value").isNotNull()
    single = F.startswith(head, F.lit("{")) & is_object & F.json_object_keys(head).isNull()
    if not spark.read.text(path, wholetext=True).filter(~(array | single)).limit(1).count():
        return "documents"
    return "damaged" if lines["objects"] else "none"


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """S3: JSON lines or JSON documents (``json_layout``); a file that is neither is an error.  ``read_many`` routes single
    bad lines."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    layout = json_layout(spark, path)
    if layout not in ("lines", "documents"):
        raise ValueError(f"{path}: neither JSON lines nor JSON documents")
    return r.option("multiLine", True).json(path) if layout == "documents" else r.json(path)


def read_table(spark: SparkSession, path: str, max_rows: int | None = None, normalize: bool = False) -> DataFrame:
    """Dispatch on the suffix; ``max_rows`` is a preview cap (``limit``), not a sample."""
    p = path.lower()
    if p.endswith(".csv"):
        df = read_csv(spark, path)
    elif p.endswith((".json", ".jsonl")):
        df = read_json(spark, path)
    elif p.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format: {path}")
    if normalize:
        df = normalize_columns(df)
    return df.limit(max_rows) if max_rows else df


def inventory(spark: SparkSession, root: str, suffixes: Iterable[str] = SUPPORTED_SUFFIXES) -> DataFrame:
    """S6 + S7: recursive file listing (path, name, suffix, size_mb) with only metadata read
    (``binaryFile`` with the content column pruned), filtered to the supported suffixes."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return (files.select("path", name.alias("name"), suffix.alias("suffix"),
                         F.round(F.col("length") / (1024 * 1024), 3).alias("size_mb"))
            .where(F.col("suffix").isin(*list(suffixes))))


def read_many(spark: SparkSession, paths: Iterable[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Open each file; a file that cannot be read becomes an error row and the run goes on, and so does each record
    that doesn't fit the columns of its file.  Returns the good rows per path and the error rows (file, record, error); both are
    read when they are used."""
    ok, failed, routed = {}, [], []
    for p in paths:
        try:
            if p.lower().endswith(".csv"):
                (encoding, _), = file_encodings(spark, p, ENCODINGS).items()
                ok[p], bad = read_records(spark, p, "csv", read_csv(spark, p, encodings=(encoding,)).schema, encoding)
                routed.append(bad)
            elif p.lower().endswith((".json", ".jsonl")) and json_layout(spark, p) in ("lines", "damaged"):
                found = spark.read.json(p).schema
                ok[p], bad = read_records(spark, p, "json", StructType([f for f in found if f.name != CORRUPT]))
                routed.append(bad)
            else:
                ok[p] = read_table(spark, p)
        except Exception as e:  # noqa: BLE001
            failed.append(Row(file=p, record=None, error=repr(e)))
    errors = spark.createDataFrame(failed, "file string, record string, error string")
    return ok, reduce(lambda a, b: a.unionByName(b), routed, errors)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of the split files that exist, with a ``split`` literal column.  Only a path that does
    not exist is skipped; a split that can't be read is an error."""
    frames = []
    for split, path in paths.items():
        try:
            frames.append(read_table(spark, path).withColumn("split", F.lit(split)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        raise ValueError("no split could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write any result (parquet by default, csv with header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_record(spark: SparkSession, record: dict, path: str) -> None:
    """A manifest / run summary as a one-row JSON file."""
    spark.createDataFrame([Row(record=json.dumps(record, default=str, sort_keys=True))]).coalesce(1) \
        .write.mode("overwrite").text(path)


RUN_LOG = ("source", "asset", "horizon", "status", "n_rows", "n_dates", "out_dir", "error")


def run_log(cells: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Status table of an experiment grid (source, asset, horizon, status, n_rows, n_dates, out_dir, error) from the
    cells of a fitted grid; ``out_dir`` is the folder that ``write_grid`` wrote to."""
    part = lambda c: F.concat(F.lit(f"/{c}="), F.col(c).cast("string"))
    place = F.concat(F.lit(out_dir), part("source"), part("asset"), part("horizon")) if out_dir else F.lit(None).cast("string")
    return cells.withColumn("out_dir", F.when(F.col("status") == "ok", place)).select(*RUN_LOG)


def write_grid(cells: DataFrame, results: DataFrame, out_dir: str) -> DataFrame:
    """S12 + S15: results partitioned by cell under ``out_dir``, and the run log beside them; returns the log."""
    results.write.mode("overwrite").partitionBy("source", "asset", "horizon").parquet(out_dir)
    log = run_log(cells, out_dir)
    write_table(log, out_dir.rstrip("/") + "_log", "csv")
    return log
