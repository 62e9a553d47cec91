"""Tabular uploads: CSV and Parquet scans, the row cap of a sheet, and Markdown rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.functions.text import file_extension, supported_file

ROWS_PER_SHEET = 500
EMPTY_TABLE = "*(tabla vacía)*"  # fixed value


def rows_per_sheet_cap(rows: DataFrame, sheet: list[str], order: list[str], limit: int | None = ROWS_PER_SHEET) -> DataFrame:
    """First rows of every sheet, numbered from 1. Each input task keeps at most ``limit`` per sheet.

    The cap is the reference feature; ``limit=None`` keeps (and does not number) every row.
    """
    if limit is None:
        return rows
    window = Window.partitionBy(*sheet).orderBy(*order)
    return rows.withColumn("row_no", F.row_number().over(window)).filter(F.col("row_no") <= limit)


def _with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    ).withColumn("__pos", F.monotonically_increasing_id())


def _capped(df: DataFrame, limit: int | None) -> DataFrame:
    capped = rows_per_sheet_cap(_with_position(df), ["__file"], ["__block", "__pos"], limit)
    return capped.withColumnRenamed("__file", "file_path").drop("__block", "__pos")


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every row (``limit``: the first ones of each file); a schema saves the inference pass."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _capped(reader.csv(path), limit)


def scan_parquet(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Parquet files, every row; with ``limit`` the first rows of each file, numbered."""
    return _capped(spark.read.parquet(*([path] if isinstance(path, str) else path)), limit)


def filter_supported_files(files: DataFrame, name: str = "path") -> DataFrame:
    return files.filter(supported_file(F.col(name))).withColumn("extension", file_extension(F.col(name)))


def all_null_columns(df: DataFrame) -> DataFrame:
    """One row per column with its number of values, from one aggregation."""
    names = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "non_null")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one row of counts is read by the driver."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def markdown_lines(rows: DataFrame, sheet: list[str], columns: list[str], row_no: str = "row_no") -> DataFrame:
    """Every row as one Markdown table line: sheet, row_no, line."""
    cells = [F.coalesce(F.trim(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(*sheet, row_no, line.alias("line"))


def render_markdown(rows: DataFrame, sheet: list[str], columns: list[str], row_no: str = "row_no") -> DataFrame:
    """One Markdown table per sheet, of all rows given. A table is one text: cap the sheets first
    (``rows_per_sheet_cap``), or take ``markdown_lines``, which has a row per line and no such bound.
    """
    lines = markdown_lines(rows, sheet, columns, row_no)
    header = "| " + " | ".join(c.strip() for c in columns) + " |"
    rule = "| " + " | ".join(["---"] * len(columns)) + " |"
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(row_no, "line"))), lambda r: r["line"]), "\n"
    )
    return lines.groupBy(*sheet).agg(F.concat(F.lit(header + "\n" + rule + "\n"), body).alias("markdown"))


def join_sections(tables: DataFrame, file: str, sheet: str, markdown: str = "markdown") -> DataFrame:
    """Sheets of a file under their titles, in sheet order, separated by a rule."""
    section = F.concat(F.lit("## Pestaña: "), F.col(sheet), F.lit("\n\n"), F.coalesce(F.col(markdown), F.lit(EMPTY_TABLE)))
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(sheet).alias("s"), section.alias("t")))), lambda r: r["t"]
        ),
        "\n\n---\n\n",
    )
    return tables.groupBy(file).agg(joined.alias("markdown"))
