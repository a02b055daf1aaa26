"""Scans of files in unknown encodings and of nested markup, each with a row of findings for every file or document."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.operators.tables import SMALL_ROWS
from quillon.sources.files import ENCODINGS, shared_table

#: Tables that may lawfully have a header and no rows.
ZERO_EVENT = ("all_failures.tsv", "comparison_skips.tsv", "halogen_bonds.tsv", "metal_interactions.tsv", "plip_parse_failures.tsv")
#: Rows of a file that are given out together.
BATCH = 5000
SCANNED = "path string, name string, n_bytes long, sha256 string, encoding string, n_rows long, columns array<string>, n_ragged long, error string, line long, cells array<string>"


def decoded(content: bytes) -> tuple[str, str] | None:
    """The first encoding that reads the bytes strictly, and the text without a byte order mark."""
    for encoding in ENCODINGS:
        try:
            return encoding, content.decode(encoding).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return None


def write_encoded(files: DataFrame, path: str, name: str = "name", text: str = "text", encoding: str = "encoding") -> DataFrame:
    """Write each row's text as a file of its name below path, in its encoding; gives name, n_bytes and sha256 of what was written.

    A file appears whole or not at all, so repeated tasks do no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            sizes, digests = [], []
            for n, t, e in zip(*(batch[c].to_pylist() for c in ("n", "t", "e")), strict=True):
                data, at = t.encode(e), f"{root}/{n}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part) as sink:
                    sink.write(data)
                store.move(part, at)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.record_batch([batch["n"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["name", "n_bytes", "sha256"])

    return shared_table(files.select(F.col(name).alias("n"), F.col(text).alias("t"), F.col(encoding).alias("e")).mapInArrow(write, "name string, n_bytes long, sha256 string"))


def scan_delimited(spark: SparkSession, path: str, separators: dict[str, str] | None = None, zero_event: Sequence[str] = ZERO_EVENT) -> tuple[DataFrame, DataFrame]:
    """All delimited files below path: a row for each of them, and their rows.

    Files: path, name, n_bytes, sha256, encoding, n_rows, n_columns, columns,
    n_ragged (rows whose number of cells is not the header's), status and issue.
    Status is FAIL for an empty file, one that does not parse, ragged rows, and a header without
    rows unless the file's name is in zero_event. Rows: path, line (from 1) and cells.
    Each file is read, decoded and cut once, and its rows leave in batches.
    """
    by_suffix = separators or {"csv": ",", "tsv": "\t", "tab": "\t"}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = content.as_py()
                name = where.rpartition("/")[2]
                found, header, n, ragged, error, rows = decoded(data), None, 0, 0, None, []
                try:
                    if found is None:
                        raise ValueError("no encoding reads it")
                    for row in csv.reader(io.StringIO(found[1], newline=""), delimiter=by_suffix.get(name.rpartition(".")[2].lower(), ","), strict=True):
                        if header is None:
                            header = row
                            continue
                        n += 1
                        ragged += len(row) != len(header)
                        rows.append({"path": where, "line": n, "cells": row})
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                except (ValueError, csv.Error) as e:
                    error = f"{type(e).__name__}: {e}"
                fact = {"path": where, "name": name, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "encoding": found and found[0], "n_rows": n, "columns": header, "n_ragged": ragged, "error": error}
                yield pa.RecordBatch.from_pylist([*rows, fact], kinds)

    simple = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds = pa.schema([(c.split()[0], simple[c.split()[1]]) for c in SCANNED.split(", ")])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    both = shared_table(files.mapInArrow(scan, SCANNED)).unionByName(_empty_files(files), allowMissingColumns=True)
    issue = (
        F.when(F.col("n_bytes") == 0, "empty file").when(F.col("error").isNotNull(), F.col("error")).when(F.col("columns").isNull() | (F.size("columns") == 0), "missing header")
        .when(F.col("n_ragged") > 0, F.concat(F.col("n_ragged").cast("string"), F.lit(" rows have inconsistent column count")))
        .when((F.col("n_rows") == 0) & ~F.col("name").isin(list(zero_event)), "header only; no data rows")
    )
    facts = both.filter("name is not null").select("path", "name", "n_bytes", "sha256", "encoding", "n_rows", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"), "columns", "n_ragged", issue.alias("issue"))
    return facts.withColumn("status", F.when(F.col("issue").isNull(), "PASS").otherwise("FAIL")), both.filter("name is null").select("path", "line", "cells")


def _empty_files(files: DataFrame) -> DataFrame:
    """path, name, n_bytes, sha256, n_rows and n_ragged of files without a byte, which Spark's readers pass over; it has the names on the driver anyway."""
    listed = files.sparkSession.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    absent = listed.join(files.select("path"), "path", "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_rows", "n_ragged")]
    return absent.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"), *zero)


def named_cells(rows: DataFrame, files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """path, line and the named columns as text, by each file's own header; null where a file lacks the column or a row its cell."""
    heads = files.filter("n_columns > 0").select("path", "columns")
    heads = F.broadcast(heads) if heads.count() <= SMALL_ROWS else heads
    cell = lambda c: F.when(F.array_position("columns", c) > 0, F.get("cells", (F.array_position("columns", c) - 1).cast("int")))
    return rows.join(heads, "path").select("path", "line", *[cell(c).alias(c) for c in columns])


def inventory(spark: SparkSession, path: str, text_suffixes: Sequence[str]) -> DataFrame:
    """path, name, file_type, n_bytes, sha256, readable_status, encoding and notes of every file below path.

    Files with a text suffix, or none, must decode; others have a hash only.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data, name = content.as_py(), where.rpartition("/")[2]
                suffix = f".{name.rpartition('.')[2].lower()}" if "." in name else ""
                text = not suffix or suffix in text_suffixes
                found = decoded(data) if text and b"\0" not in data else None
                status = "unreadable" if text and found is None else "readable"
                notes = "text decode failed" if status == "unreadable" else f"encoding={found[0]}" if found else "hash only"
                rows.append((where, name, suffix or "extensionless", len(data), hashlib.sha256(data).hexdigest(), status, found and found[0], notes))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    names = ["path", "name", "file_type", "n_bytes", "sha256", "readable_status", "encoding", "notes"]
    kinds = [pa.int64() if n == "n_bytes" else pa.string() for n in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    made = files.mapInArrow(look, ", ".join(f"{n} {'long' if n == 'n_bytes' else 'string'}" for n in names))
    suffix = F.concat(F.lit("."), F.lower(F.substring_index("name", ".", -1)))
    empty = _empty_files(files).select("path", "name", F.when(F.contains("name", F.lit(".")), suffix).otherwise("extensionless").alias("file_type"), "n_bytes", "sha256", F.lit("readable").alias("readable_status"), F.lit(None).cast("string").alias("encoding"), F.lit("empty").alias("notes"))
    return made.unionByName(empty)


def nested_events(docs: DataFrame, text_col: str, path: Sequence[str], tag_types: dict[str, str], fields: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Events of XML documents, and the documents that don't parse.

    An event is an element, below the containers `path` of the root, whose tag is
    known; it has event_type and, for each of fields, the first of its alternative
    children that is not blank, else empty text. A document is parsed once, by
    a schema of the known names, and all its tags give their events together.
    """
    names = list(dict.fromkeys(n for alternatives in fields.values() for n in alternatives))
    tag = f"ARRAY<STRUCT<{', '.join(f'`{n}`: STRING' for n in names)}>>"
    schema = ", ".join(f"`{t}`: {tag}" for t in tag_types)
    for container in reversed(path):
        schema = f"`{container}`: STRUCT<{schema}>"
    parsed = docs.withColumn("_x", F.from_xml(F.col(text_col), f"STRUCT<{schema}, `_bad`: STRING>", {"columnNameOfCorruptRecord": "_bad"}))
    at = reduce(lambda c, n: c[n], path, F.col("_x"))

    def events(t: str, kind: str) -> Column:
        def one(e: Column) -> Column:
            value = lambda alternatives: F.coalesce(*[F.nullif(F.trim(e[n]), F.lit("")) for n in alternatives], F.lit(""))
            return F.struct(F.lit(kind).alias("event_type"), *[value(a).alias(f) for f, a in fields.items()])

        return F.coalesce(F.transform(at[t], one), F.array().cast(f"array<struct<event_type: string, {', '.join(f'{f}: string' for f in fields)}>>"))

    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    broken = F.col("_x").isNull() | F.col("_x._bad").isNotNull()
    found = parsed.filter(~broken).select(*keep, F.inline(F.concat(*[events(t, k) for t, k in tag_types.items()])))
    return found, parsed.filter(broken).select(*keep, F.lit("no readable markup").alias("reason"))


def fixed_width_report(lines: DataFrame, file_col: str, text_col: str, record: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """file, n_records (lines that match `record`), n_bad (a field is no number), status and issue of every file."""
    from quillon.sources.files import fixed_width

    cut = fixed_width(lines.withColumn("_is", F.col(text_col).rlike(record)), text_col, fields)
    bad = F.col("_is") & reduce(lambda a, b: a | b, [F.col(n).isNull() for n in fields])
    counts = cut.groupBy(file_col).agg(F.count_if("_is").alias("n_records"), F.count_if(bad).alias("n_bad"))
    issue = F.when(F.col("n_records") == 0, "no records").when(F.col("n_bad") > 0, F.concat_ws("", F.col("n_bad"), F.lit("/"), F.col("n_records"), F.lit(" records malformed")))
    return counts.withColumn("issue", issue).withColumn("status", F.when(F.col("issue").isNull(), "PASS").otherwise("FAIL"))
