"""Tolerant scans and sinks. Scans return a table and, where rows or files can fail, an issue table."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "latin1")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read back."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, suffix, n_bytes, sha256, encoding (null for bytes that no text has), of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    binary = F.position(F.lit(b"\0"), F.col("content")) > 0
    encoding = F.when(binary, None).when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("latin1")
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"),
        F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), encoding.alias("encoding"),
    )


def unique_matches(inventory: DataFrame, wanted: DataFrame, path_col: str = "path") -> DataFrame:
    """wanted (column key) with the one file whose path ends with the key in any case; none or several are an error."""
    named = inventory.select(F.col(path_col), F.lower(F.element_at(F.split(path_col, "/"), -1)).alias("_k"))
    found = named.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.max(path_col).alias("_p"))
    joined = wanted.withColumn("_k", F.lower("key")).join(found, "_k", "left")
    return joined.select("key", F.when(F.col("_n") == 1, F.col("_p")).alias("path"), F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n").isNull(), "missing").otherwise("ok").alias("status"))


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding and text of every file, by the first encoding that reads it strictly."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for encoding in ENCODINGS:
                    try:
                        rows.append((name, encoding, bytes(content).decode(encoding).removeprefix("﻿")))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(rows, columns=["path", "encoding", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(decode, "path string, encoding string, text string")


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated rows; an absent or empty path gives an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, escape='"')
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows with as many fields as the schema, typed, and the ragged lines."""
    whole = StructType.fromJson(schema.jsonValue()).add("_bad", "string")
    rows = spark.read.csv(path, header=True, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").withColumn("path", F.input_file_name())
    rows = shared_table(rows)  # the parser gives its bad lines only with all columns read
    return rows.filter("_bad is null").drop("_bad", "path"), rows.filter("_bad is not null").select("path", F.col("_bad").alias("line"))


def stem_keyed(spark: SparkSession, path: str, schema: StructType | str, key: str = "key") -> DataFrame:
    """All CSV files of a folder with the file's stem as key."""
    return spark.read.csv(path, header=True, schema=schema).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias(key), "*")


def header_rows(lines: DataFrame, text_col: str, file_col: str, number_col: str, required: Sequence[str], within: int = 10) -> DataFrame:
    """For each file the number of the first line, of the first `within`, that holds all required names."""
    cells = F.transform(F.split(text_col, ","), lambda c: F.trim(c))
    missing = F.array_except(F.array(*map(F.lit, required)), cells)
    return lines.filter((F.col(number_col) < within) & (F.size(missing) == 0)).groupBy(file_col).agg(F.min(number_col).alias("header_line"))


def blocks(lines: DataFrame, file_col: str, number_col: str, begins: Column) -> DataFrame:
    """lines with block, the number of begins up to and with the line; 0 before the first."""
    w = Window.partitionBy(file_col).orderBy(number_col).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(begins.cast("int")).over(w))


def block_table(lines: DataFrame, file_col: str, number_col: str, text_col: str, start: str, value: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Blocks that begin at lines like `start`: file, block, value and n_items where a block has one value line and some item line; all others as issues."""
    text = F.col(text_col)
    own = blocks(lines, file_col, number_col, text.rlike(start)).filter("block > 0")
    made = own.groupBy(file_col, "block").agg(
        F.count_if(text.rlike(value)).alias("n_values"), F.count_if(text.rlike(item)).alias("n_items"),
        F.max(F.when(text.rlike(value), F.regexp_extract(text, value, 1).try_cast("double"))).alias("value"),
    )
    reason = F.when(F.col("n_values") != 1, "values").when(F.col("n_items") == 0, "no_items")
    judged = made.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason", "n_values"), judged.filter("reason is not null").drop("value")


def fixed_width(lines: DataFrame, text_col: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Numbers at [from, to) of each line; text that is no number is null."""
    return lines.withColumns({n: F.substring(text_col, a + 1, b - a).try_cast("double") for n, (a, b) in fields.items()})


def xml_events(docs: DataFrame, text_col: str, tag_types: dict[str, str]) -> DataFrame:
    """A row for each element whose tag is known, with its type and text, from a column of XML."""
    rows = [
        docs.select("*", F.explode(F.expr(f"xpath(`{text_col}`, '//{tag}/text()')")).alias("value")).withColumn("type", F.lit(kind))
        for tag, kind in tag_types.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.drop(text_col)


def write_tsv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The listed columns, tabs and line breaks as spaces; quotes are doubled, and null and empty text are both an empty cell."""
    clean = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in fields]
    df.select(*clean).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> str:
    """A new version of a CSV table below path, earlier ones stay; gives the version's path."""
    version = f"{path}/version={time.time_ns():020d}"
    df.write.csv(version, header=True, emptyValue="")
    return version


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each table, named by at most 31 characters."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name[:31]}")


def write_by_type(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)
