"""The result vault: one JSON text per analysed document, in directories by company.

A vault of many companies lies in slots instead, directories by the MD5 of the company: a directory for each of very many
companies costs a file and several calls to the file system for a handful of rows. How a vault lies is chosen once, as it is
first written, and seen from its columns afterwards. In a slot the rows are sorted by company, so a reader of one company opens
one directory and skips the row groups of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import dims
from ledgerloom.functions.text import company_from_path
from ledgerloom.operators.documents import decoded_only, dig, quarantine
from ledgerloom.operators.resolve import lookup_portfolio
from ledgerloom.operators.skew import attach_by_key, written
from ledgerloom.operators.touched import SLOT, exists, slot_of

METADATA = [
    "file_hash", "original_filename", "founder_email", "portfolio_id", "processed_at", "copied_from_general",
]


def _relative(path: Column, root: str) -> Column:
    """Decoded path below the vault root, with the root's own last name in front."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit(name + "/"), F.substring_index(plain, "/" + name + "/", -1))


def _placed(files: DataFrame, root: str) -> DataFrame:
    """id, company_domain, gcs_path and value of file texts read from below ``root``."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    placed = files.select(_relative(F.col("_metadata.file_path"), root).alias("gcs_path"), "value")
    domain = company_from_path(F.col("gcs_path"))
    bare = F.replace(F.col("gcs_path"), F.lit(".json"), F.lit(""))
    return placed.select(F.replace(bare, F.concat(F.lit(name + "/"), domain, F.lit("/")), F.lit("")).alias("id"), domain.alias("company_domain"), "gcs_path", "value")


def json_texts(spark: SparkSession, root: str, company: str | None = None, stream: bool = False) -> DataFrame:
    """Texts of the files ``{root}/{company}/{id}.json``: id, company_domain, gcs_path, value; as a batch or a stream.

    Files are listed and read in parallel. With a company only its directory is listed; one without has no results.
    Spark's file sources skip files of no bytes, so such a file is neither a result nor in quarantine.
    """
    path = root if company is None else f"{root.rstrip('/')}/{company}"
    if not stream and not exists(spark, path):
        return spark.createDataFrame([], "id string, company_domain string, gcs_path string, value string")
    reader = spark.readStream if stream else spark.read
    return _placed(reader.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path), root)


def scan_json_files(spark: SparkSession, root: str, company: str | None = None) -> DataFrame:
    """Results stored as files: id, company_domain, gcs_path, doc. Malformed and non-object texts are left out."""
    return decoded_only(json_texts(spark, root, company), "value").drop("value")


def scan_json_quarantine(spark: SparkSession, root: str, company: str | None = None) -> DataFrame:
    """The files that ``scan_json_files`` leaves out: their path, text (value) and reason."""
    return quarantine(json_texts(spark, root, company), "value")


def write_json_files(results: DataFrame, root: str) -> None:
    """Each result (company_domain, id, raw_json) as a file ``{root}/{company_domain}/{id}.json``.

    Tasks write their own files: beside the target first, then moved, so a reader sees whole files only and a
    repeated task replaces what it wrote. Any file system that Arrow knows by its address will do.
    """

    def write(rows) -> None:
        from pyarrow import fs

        if "://" in root:
            store, base = fs.FileSystem.from_uri(root)
        else:
            store, base = fs.LocalFileSystem(), root.removeprefix("file:")
        made: set[str] = set()
        for row in rows:
            folder = f"{base.rstrip('/')}/{row['company_domain']}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            target = f"{folder}/{row['id']}.json"
            with store.open_output_stream(f"{target}.part") as out:
                out.write((row["raw_json"] or "").encode())
            store.move(f"{target}.part", target)

    results.select("company_domain", "id", "raw_json").foreachPartition(write)


def vault_slot(digits: int) -> Column:
    """Slot of a result: a letter, so that no slot reads as a number, and the first digits of the MD5 of its company."""
    return F.concat(F.lit("s"), slot_of(["company_domain"], digits))


def write_result_vault(results: DataFrame, path: str, digits: int = 0) -> None:
    """Append results (file_hash, company_domain, raw_json and metadata) by company, or in 16 ** ``digits`` slots.

    The rebalance hint lets adaptive execution merge small companies or slots and split a huge one.
    """
    if digits:
        placed = results.withColumn(SLOT, vault_slot(digits)).hint("rebalance", F.col(SLOT)).sortWithinPartitions(SLOT, "company_domain")
        placed.write.mode("append").partitionBy(SLOT).parquet(path)
    else:
        results.hint("rebalance", F.col("company_domain")).write.mode("append").partitionBy("company_domain").parquet(path)


def of_company(stored: DataFrame, company: str) -> DataFrame:
    """Results of one company: only its directory, or its slot, is read."""
    found = stored.filter(F.col("company_domain") == company)
    if SLOT not in stored.columns:
        return found
    # slots of any number of digits begin alike
    whole = F.md5(F.lit(company).cast("binary"))
    return found.filter(F.concat(F.lit("s"), F.substring(whole, F.lit(1), F.length(SLOT) - 1)) == F.col(SLOT))


def scan_result_vault(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """Stored results with decoded document, fund and date; one company reads one directory."""
    stored = spark.read.parquet(path)
    return result_items(stored if company is None else of_company(stored, company))


def result_items(stored: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """Result list: malformed documents left out, metadata defaults filled, newest first left to the caller."""
    decoded = decoded_only(stored)
    unknown = F.lit("unknown")
    fund = F.coalesce(F.when(F.col("portfolio_id") != "", F.col("portfolio_id")), lookup_portfolio(F.col("company_domain"), names))
    return decoded.select(
        F.concat(F.col("file_hash"), F.lit("_result")).alias("id"),
        "company_domain",
        "file_hash",
        F.coalesce("original_filename", unknown).alias("original_filename"),
        F.coalesce("founder_email", unknown).alias("founder_email"),
        F.coalesce(F.col("processed_at").cast("string"), unknown).alias("date"),
        fund.alias("portfolio_id"),
        "doc",
    )


def result_by_hash(stored: DataFrame, file_hash: str | Column) -> DataFrame:
    """The stored result of a content hash, that of the first company; the filter reaches the file scan.

    ``file_hash`` may be a scalar subquery, which runs inside the same query.
    """
    return stored.filter(F.col("file_hash") == file_hash).orderBy("company_domain", "original_filename", "raw_json").limit(1)


def copies_for(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Results of another company with the same hash, re-addressed to the incoming company.

    ``incoming``: company_domain, file_hash, founder_email. Nothing is copied that the company has.
    """
    own = stored.select("company_domain", "file_hash")
    wanted = incoming.groupBy("company_domain", "file_hash").agg(F.min("founder_email").alias("founder_email"))
    missing = wanted.join(own, ["company_domain", "file_hash"], "left_anti")
    source = stored.groupBy("file_hash").agg(
        F.min_by(F.struct("raw_json", "original_filename"), F.col("company_domain")).alias("src")
    )
    return attach_by_key(missing, source, ["file_hash"], how="inner").select(
        "file_hash", "company_domain", "founder_email",
        F.coalesce("src.original_filename", F.lit("unknown")).alias("original_filename"),
        F.col("src.raw_json").alias("raw_json"),
        F.lit(True).alias("copied_from_general"),
    )


def copy_to_vault(incoming: DataFrame, path: str, processed_at: Column | None = None) -> None:
    """Copies of results that a company lacks, written into its partition or slot of the vault at ``path``.

    The copies are complete in a table beside the vault before the first is appended, so the vault is not read while it grows.
    """
    stored = incoming.sparkSession.read.parquet(path)
    found = copies_for(incoming, stored)
    if "processed_at" in stored.columns:
        at = F.current_timestamp() if processed_at is None else processed_at
        found = found.withColumn("processed_at", at.cast(stored.schema["processed_at"].dataType))
    digits = len(stored.select(F.max(SLOT)).first()[0] or "s") - 1 if SLOT in stored.columns else 0
    write_result_vault(written(found, "copies"), path, digits)


# The four sections a usable document needs two of.
KEY_SECTIONS = ["revenue_growth", "profit_margins", "cash_flow_indicators", "debt_ratios"]


def audit_vault_files(files: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Adds file_status: the first rule a stored text breaks, or ``valid``."""
    first = F.try_parse_json(F.col(raw))
    doc = F.when(
        F.schema_of_variant(first) == "STRING", F.try_parse_json(F.try_variant_get(first, "$", "string"))
    ).otherwise(first)
    checked = files.withColumn("__doc", doc)
    metrics = dig(F.col("__doc"), [dims.ROOT])
    kind = F.schema_of_variant(metrics)

    def filled(section: str) -> Column:
        text = F.to_json(dig(F.col("__doc"), [dims.ROOT, section]))
        return F.coalesce(~text.isin("null", "{}", "[]", '""', "0", "0.0", "false"), F.lit(False)).cast("int")

    sections = sum((filled(s) for s in KEY_SECTIONS), F.lit(0))
    status = (
        F.when(F.col("__doc").isNull(), "json_error")
        .when(~F.schema_of_variant("__doc").startswith("OBJECT"), "not_object")
        .when(metrics.isNull(), "missing_metrics")
        .when(~kind.startswith("OBJECT") | (F.to_json(metrics) == "{}"), "empty_metrics")
        .when(sections < 2, "insufficient_metrics")
        .otherwise("valid")
    )
    return checked.withColumns({"file_status": status, "section_count": sections}).drop("__doc")


def vault_file_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("file_status").agg(F.count(F.lit(1)).alias("files"))
