"""Strict CSV: lines are records, so a file is read in splits and every line is judged on its own.

Comma and doubled double quotes; line ends are LF or CRLF; no line feed inside a field, no trimming, no inference: every
column is text and an empty field is not a missing one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.lookup import joinable

# Possessive throughout: Java then walks fields and records of any length in a loop, where it would recurse otherwise.
_FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
_RECORD = rf"^(?:{_FIELD})(?:,(?:{_FIELD}))*+\z"


def fields(line: Column) -> Column:
    """The fields of a well-formed record, unquoted."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_FIELD})"), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, 2, F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def problem(line: Column, width: int | None = None) -> Column:
    """What is wrong with a record: blank_record, invalid_utf8, control_character, byte_order_mark, quoting, or record_width; else null."""
    checks = (
        F.when(line == "", F.lit("blank_record"))
        .when(~F.is_valid_utf8(line), F.lit("invalid_utf8"))
        .when(line.rlike(r"[\x00-\x08\x0B-\x1F\x7F]"), F.lit("control_character"))
        .when(line.contains("﻿"), F.lit("byte_order_mark"))
        .when(~line.rlike(_RECORD), F.lit("quoting"))
    )
    return checks if width is None else checks.when(F.size(fields(line)) != width, F.lit("record_width"))


def scan_lines(lines: DataFrame, width: int, line: str = "value") -> DataFrame:
    """Each line with its fields (null where it has a problem) and its problem. A final carriage return belongs to the line end."""
    bare = F.regexp_replace(F.col(line), r"\r\z", "")
    return lines.withColumn("problem", problem(bare, width)).withColumn("fields", F.when(F.col("problem").isNull(), fields(bare)))


def header_of(line: str) -> list[str]:
    """Column names of a header line: unique and not empty. A byte order mark may begin the file."""
    names, rest = [], "," + line.removeprefix("﻿").rstrip("\r\n")
    for raw in re.findall(rf",({_FIELD})", rest):
        names.append(raw[1:-1].replace('""', '"') if raw.startswith('"') else raw)
    if not all(names) or len(set(names)) != len(names):
        raise ValueError("column names are unique and not empty")
    return names


def read_strict(spark: SparkSession, path: str, dots: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of the CSV files under ``path``: all columns are text; the first line of each file is its header.

    The header of the first file names the columns; a file with another one has the problem ``header`` on all its lines.
    Only a file's first line is taken for its header: rows like it are rows. Lines end with LF or CRLF, and a carriage
    return elsewhere is a control character. ``dots`` writes names with dots for slashes, as water quality services do.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    first = text.first()
    if first is None:
        raise ValueError("a file without a header")
    names = header_of(first["value"])
    # A file is read in splits; its first line is the first row of the split at its beginning.
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    heads = lines.where("_at = 0").groupBy("_file").agg(F.min(F.struct("_row", "value")).alias("_head"))
    bare = lambda c: F.regexp_replace(c, "^\ufeff|\r\\z", "")
    body = lines.join(joinable(heads), "_file").where((F.col("_at") > 0) | (F.col("_row") != F.col("_head._row")))
    scanned = scan_lines(body, len(names)).withColumn("problem", F.when(bare(F.col("_head.value")) != bare(F.lit(first["value"])), F.lit("header")).otherwise(F.col("problem")))
    shown = [n.replace("/", ".") if dots else n for n in names]
    rows = scanned.where("problem IS NULL").select(*[F.col("fields")[i].alias(n) for i, n in enumerate(shown)])
    return rows, scanned.where("problem IS NOT NULL").select("value", "problem")


def csv_documents(docs: DataFrame, required: tuple[str, ...] = (), dots: bool = False) -> DataFrame:
    """Whole CSV texts as they come from a service (doc_id, body): adds names, lines, problem, rows and columns.

    problem: header (not unique, empty, malformed, or without a name that is ``required``), or that of the first line that
    has one. A final line end ends the last record and begins none.
    """
    lines = F.transform(F.split(F.regexp_replace(F.col("body"), r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    cut = docs.withColumn("_lines", lines)
    head = F.regexp_replace(F.get(F.col("_lines"), F.lit(0)), "^\ufeff", "")
    cut = cut.withColumn("_head", head).withColumn("names", F.when(problem(F.col("_head")).isNull(), fields(F.col("_head"))))
    if dots:
        cut = cut.withColumn("names", F.transform("names", lambda n: F.replace(n, F.lit("/"), F.lit("."))))
    fine = (F.size(F.array_distinct("names")) == F.size("names")) & ~F.array_contains("names", "")
    for name in required:
        fine = fine & F.array_contains("names", name)
    cut = cut.withColumn("lines", F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))).withColumn("columns", F.size("names"))
    wrong = F.get(F.filter(F.transform("lines", lambda x: F.coalesce(problem(x), F.when(F.size(fields(x)) != F.col("columns"), F.lit("record_width")))), lambda p: p.isNotNull()), F.lit(0))
    cut = cut.withColumn("problem", F.when(~F.coalesce(fine, F.lit(False)), F.lit("header")).otherwise(wrong))
    return cut.select(*docs.columns, "names", "lines", "problem", F.size("lines").alias("rows"), "columns")


def csv_document_rows(docs: DataFrame, required: tuple[str, ...] = (), dots: bool = False) -> DataFrame:
    """doc_id, row (from 1) and record (map of names to texts) of CSV texts without a problem."""
    rows = csv_documents(docs, required, dots).select("doc_id", "names", F.posexplode(F.when(F.col("problem").isNull(), F.col("lines"))).alias("row", "line"))
    return rows.select("doc_id", (F.col("row") + 1).cast("long").alias("row"), F.map_from_arrays("names", fields(F.col("line"))).alias("record"))


#: The columns of a water quality result, with dots for slashes, that harmonizing needs.
WATER_QUALITY = ("MonitoringLocationIdentifier", "ActivityStartDate", "ActivityStartTime.Time", "ActivityStartTime.TimeZoneCode", "CharacteristicName", "ResultMeasureValue", "ResultMeasure.MeasureUnitCode")


def with_names(rows: DataFrame, names: list[str], array: str = "fields") -> DataFrame:
    """Columns of an array of fields, by name, as text."""
    return rows.select(*[c for c in rows.columns if c != array], *[F.col(array)[i].alias(n) for i, n in enumerate(names)])


def schema_table(df: DataFrame) -> DataFrame:
    """Index, name and storage type of every column."""
    return df.sparkSession.createDataFrame([(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "column_index int, name string, storage string")


def _hash_leaves(rows: DataFrame, number: str, columns: list[str]) -> DataFrame:
    """n (from 0), and each column's value as the text that is hashed: c0, c1, …"""
    text = lambda c: F.coalesce(F.concat(F.lit("V"), F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N"))
    return rows.select((F.col(number) - 1).alias("n"), *[text(c).alias(f"c{i}") for i, c in enumerate(columns)])


def _hash_level(level: DataFrame, columns: list[str], fan: int) -> DataFrame:
    """The next level of the tree: ``fan`` texts or hashes of a column to one hash."""
    join = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), "\n"), 256).alias(c)
    return level.groupBy(F.floor(F.col("n") / fan).alias("chunk")).agg(*[join(f"c{i}") for i in range(len(columns))]).withColumnRenamed("chunk", "n")


def _hash_of_columns(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.concat_ws(":", F.lit(c), F.col(f"c{i}")) for i, c in enumerate(columns)]), 256)


def block_hashes(rows: DataFrame, number: str, columns: list[str], fan: int = 1024) -> DataFrame:
    """block (from 0) and result_sha256 of each block of ``fan`` times ``fan`` rows: values to chunks, chunks to columns, columns to the block.

    ``number`` numbers the rows from 1. A table of one block has the hash that ``result_hash`` gives.
    """
    level = _hash_level(_hash_level(_hash_leaves(rows, number, columns), columns, fan), columns, fan)
    return level.select(F.col("n").alias("block"), _hash_of_columns(columns).alias("result_sha256"))


def result_hash(rows: DataFrame, number: str, columns: list[str], fan: int = 1024) -> DataFrame:
    """One row, the hash of a table: values to chunks of ``fan`` rows, chunks to chunks of chunks, columns to the table.

    ``number`` numbers the rows from 1. No task holds more than ``fan`` values of a column: a tree, not one long list.
    """
    level = _hash_leaves(rows, number, columns)
    size = level.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0] + 1
    levels = 0
    while size > 1 or levels < 2:  # values to chunks, chunks to a column, however few
        level = _hash_level(level, columns, fan)
        size, levels = -(-size // fan), levels + 1
    return level.select(_hash_of_columns(columns).alias("result_sha256"))
