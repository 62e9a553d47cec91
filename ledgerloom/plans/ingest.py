"""Documents to contracts to stored tables, as one batch over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ledgerloom.functions.periods import period_year
from ledgerloom.operators import audit, contract, documents, resolve, store
from ledgerloom.operators.skew import bucketed, gathered, written
from ledgerloom.session import work_path
from ledgerloom.sources import vault


@dataclass
class Contracts:
    """Headers (one row per document), KPI rows (16 or more per document) and warning texts.

    ``texts``, if there, are the documents' texts by submission_id, which headers then do not carry from stage to stage.
    """

    headers: DataFrame
    rows: DataFrame
    warnings: DataFrame
    texts: DataFrame | None = None


#: The vault of a load lies in 256 slots, as a load may bring documents of any number of companies.
VAULT_DIGITS = 2

HEADER_INPUT = ["submission_id", "file_hash", "company_id", "founder_email", "original_filename", "submitted_at", "portfolio_id"]


def build_contracts(docs: DataFrame, rates: DataFrame | None = None, mode: str = "reference", doc: str = "doc",
                    raw: str = "raw_json", path: str | None = None, staged: bool = False) -> Contracts:
    """Contracts of all documents (``HEADER_INPUT`` columns, the decoded document and its text).

    With a ``path`` the described documents, the rows extracted from these with the derived rows, and the headers are written there
    and read back: documents are worked out and parsed once, audit, duplicate check and insert start from the staged tables, and a
    lost executor costs no more than its own files. The tables lie in buckets by submission_id, so what is grouped or joined by it
    is not shuffled. Texts stay with the documents and meet a header again when it is stored. ``staged`` says that the
    documents are such a table already, which is not written again.

    The year of ``submitted_at`` stands for the current year, so a rerun gives the same result.
    """
    year = F.year("submitted_at")
    described = docs.select(
        *HEADER_INPUT,
        documents.document_period(F.col(doc), F.col(raw), year, mode).alias("period_id"),
        documents.detect_currency(F.col(doc)).alias("currency"),
        doc,
        F.col(raw).alias("raw_gemini"),
    ).withColumn("report_year", period_year(F.col("period_id"), year))
    keep = ["submission_id", "period_id", "currency", "report_year"]
    if path is not None and not staged:
        described = bucketed(gathered(described, "submission_id"), f"{path}/documents", "submission_id").drop("__times")
    rows = documents.explode_kpis(described.select(*keep, doc), doc, keep, mode)
    rows = resolve.fx_normalize(rows, rates, mode=mode).withColumn("original_currency", F.col("currency"))

    def derive(rows: DataFrame) -> DataFrame:
        return contract.derive_margins(rows, "ordinal", mode)

    texts = None
    if path is None:
        complete = contract.append_derived(rows, derive(rows))
    else:
        empty = rows.limit(0)
        complete = bucketed(rows, f"{path}/rows", "submission_id", lambda rows: contract.append_derived(empty, derive(rows)))
        rows = complete.filter("ordinal IS NOT NULL")  # a derived row has no place in the document
        texts = described.select("submission_id", "raw_gemini")
        described = described.drop("raw_gemini")
    rollup = contract.submission_rollup(complete, mode)
    headers = described.drop(doc, "report_year").withColumnRenamed("currency", "detected_currency").join(
        rollup if path is None else rollup.hint("merge"), "submission_id"
    )
    if path is not None:
        headers = bucketed(headers, f"{path}/headers", "submission_id")
    return Contracts(headers, complete, contract.integrity_warnings(rows, rollup), texts)


@dataclass
class Inserted:
    """What a batch does to the store."""

    headers: DataFrame      # new submissions, latest flag set within the batch
    rows: DataFrame         # their KPI rows, with id and created_at
    rejected: DataFrame     # submissions with blocking errors (quarantine)
    duplicates: DataFrame   # submissions whose hash is already stored
    retired: DataFrame      # stored submissions with updated latest flags (was_latest: the flag before)


def row_id() -> Column:
    """Id of a KPI row: a document has one row per KPI, and at most one derived row besides."""
    return F.concat_ws("-", "submission_id", "kpi_key", F.coalesce(F.col("ordinal").cast("string"), F.lit("derived")))


def insert_contracts(contracts: Contracts, stored: DataFrame, names: list[tuple[str, str]] | None = None,
                     portfolio: list[tuple[str, str]] | None = None, mode: str = "reference") -> Inserted:
    """Audit, drop rejected and duplicate documents, retire older versions, fill in the fund.

    Judged headers and new submissions are written tables, so no part of the result works out the audit again. They are judged
    without their texts; rows meet their headers after they were counted.
    """
    headers = audit.with_audit_bucket(contracts.headers, names)
    carried = [c for c in headers.columns if c not in ("submission_id", "bucket_id")]
    judged = written(audit.contract_verdicts(contracts.rows, headers, mode, carried), "judged")
    accepted = judged.filter(F.col("blocking_errors") == 0)
    rejected = judged.filter(F.col("blocking_errors") > 0).select("submission_id", "errors", "warnings", "blocking_errors")
    fresh, duplicates = store.dedup_against_store(accepted, stored, staged=True)
    first = written(store.dedup_by_hash(fresh), "first")  # copies within the batch count once
    fresh = store.latest_version(first)
    fresh = written(store.fill_portfolio(fresh, portfolio).drop("errors", "warnings", "blocking_errors", "passed"), "fresh")
    # submitted_at stands for the current time, so a repeated batch gives equal rows
    placed = fresh.select("submission_id", F.col("submitted_at").cast("timestamp").alias("created_at"))
    kept = contracts.rows.join(placed.hint("shuffle_hash"), "submission_id").withColumn("id", row_id())
    retired = store.retire_versions(stored.withColumn("was_latest", F.col("is_latest_version")), fresh)
    # a submission_id that came twice repeats every KPI and is rejected, so each new one has one text
    headers = fresh if contracts.texts is None else fresh.join(contracts.texts, "submission_id", "left")
    return Inserted(headers, kept, rejected, duplicates, retired)


@dataclass
class Loaded:
    """Where a batch was written, and how many rows of each kind went there, counted while they were written."""

    root: str
    counts: dict[str, int]


def _write_counted(frames: dict[str, tuple[DataFrame, Callable[[DataFrame], None]]]) -> dict[str, int]:
    """Each frame written by its writer; its rows are observed on the way, so no frame is worked out again to be counted."""
    counts = {}
    for name, (rows, write) in frames.items():
        seen = Observation(name)
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        try:
            counts[name] = seen.get["rows"]
        except Py4JJavaError:  # a plan that Spark finds to be empty before it runs has no node left to observe
            counts[name] = 0
    return counts


def _to(path: str) -> Callable[[DataFrame], None]:
    return lambda rows: rows.write.mode("append").parquet(path)


def write_batch(inserted: Inserted, root: str) -> Loaded:
    """A batch into the tables below ``root``: submissions, facts, rejected, duplicates, and the stored submissions whose
    flag changes (retired)."""
    return Loaded(root, _write_counted({
        "submissions": (inserted.headers, lambda rows: store.append_rows(rows, f"{root}/submissions", store.SUBMISSIONS_LAYOUT)),
        "facts": (inserted.rows, lambda rows: store.append_rows(rows, f"{root}/facts", store.FACT_LAYOUT)),
        "rejected": (inserted.rejected, _to(f"{root}/rejected")),
        "duplicates": (inserted.duplicates, _to(f"{root}/duplicates")),
        "retired": (inserted.retired.filter("was_latest AND NOT is_latest_version").drop("was_latest"), _to(f"{root}/retired")),
    }))


def ingest_chunks(
    chunks: DataFrame,
    uploads: DataFrame,
    stored: DataFrame,
    root: str,
    names: list[tuple[str, str]] | None = None,
    portfolio: list[tuple[str, str]] | None = None,
    buckets: list[tuple[str, str]] | None = None,
    mode: str = "reference",
) -> Loaded:
    """From extracted chunks to stored tables: decode, merge, detect the company, gate, contract, checklist, audit, insert, vault.

    ``chunks``: submission_id, chunk_id, raw_json; ``uploads``: the header of each submission (``HEADER_INPUT`` without
    portfolio_id). ``names`` are the companies looked for in texts, ``portfolio`` those that give an undetected company its
    fund, ``buckets`` those that give it its sector. Below ``root`` appear submissions, facts, retired, duplicates,
    checklist, vault and quarantine (stage, reason): what a stage takes out is there, and nowhere behind it. Every stage
    that is read more than once is a written table.
    """
    texts = gathered(chunks.select("submission_id", "chunk_id", "raw_json"), "submission_id")
    read = bucketed(documents.decode_or_reason(texts, fenced=True).drop("raw_json"), work_path(chunks.sparkSession, "chunks"), "submission_id")
    broken = read.filter("reason IS NOT NULL").select(
        "submission_id", F.lit("decode").alias("stage"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"), F.lit(": "), "reason").alias("reason")
    )
    merged = documents.merge_chunk_documents(read.filter("reason IS NULL"), "submission_id", "chunk_id", mode=mode)
    # merged texts are never broadcast: their size is estimated from a compressed table
    found = uploads.join(merged.hint("merge"), "submission_id").withColumn(
        "__found", resolve.detect_company(F.concat_ws(" ", "raw_json", "original_filename"), names)
    )
    known = F.col("__found.company_key") != "unknown"
    placed = found.withColumns({
        "portfolio_id": F.when(known, F.col("__found.portfolio_id")).otherwise(resolve.lookup_portfolio(F.col("company_id"), portfolio)),
        "company_id": F.when(known, F.col("__found.company_key")).otherwise(F.col("company_id")),
    }).drop("__found")
    gated = documents.with_financial(documents.decoded_only(gathered(placed, "submission_id")))
    judged = bucketed(gated, work_path(chunks.sparkSession, "judged"), "submission_id")
    docs = judged.filter("financial")
    gated = judged.filter(~F.col("financial")).select("submission_id", F.lit("gate").alias("stage"), F.lit("not_financial").alias("reason"))
    contracts = build_contracts(docs, mode=mode, path=work_path(chunks.sparkSession, "contracts"), staged=True)
    inserted = insert_contracts(contracts, stored, buckets, portfolio, mode)
    heads = audit.with_audit_bucket(contracts.headers.select("submission_id", "company_id"), buckets)
    listed = contract.sector_checklist(contracts.rows, heads).select("submission_id", "bucket_id", "missing_kpis", "is_complete", "display_message")
    rejected = inserted.rejected.select("submission_id", F.lit("audit").alias("stage"), F.concat(F.col("blocking_errors").cast("string"), F.lit(" blocking errors")).alias("reason"))
    results = docs.select(
        "file_hash", F.col("company_id").alias("company_domain"), "submission_id", "raw_json", "original_filename", "founder_email", "portfolio_id",
        F.col("submitted_at").cast("string").alias("processed_at"),
    )
    done = write_batch(Inserted(inserted.headers, inserted.rows, inserted.rejected, inserted.duplicates, inserted.retired), root)
    more = _write_counted({
        "quarantine": (broken.unionByName(gated).unionByName(rejected), lambda rows: rows.write.mode("append").partitionBy("stage").parquet(f"{root}/quarantine")),
        "checklist": (listed, _to(f"{root}/checklist")),
        "vault": (results, lambda rows: vault.write_result_vault(rows, f"{root}/vault", VAULT_DIGITS)),
    })
    return Loaded(root, done.counts | more)
