"""KPI catalogues: target KPIs per company from JSON or CSV, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import scans
from ledgerloom.operators.skew import written

DEFAULT_COMPANY = "Standard_KPIs"


def catalog_from_json(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """company, position, legacy_kpi, target_kpi, audit_logic from JSON catalogue files.

    ``whole_file``: one (multi-line) object per file; otherwise one object per line.

    A company holds either a list of objects or three parallel arrays; both become rows.
    """
    text = spark.read.option("wholetext", whole_file).text(path)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("company", "rules"))
    as_list = F.from_json("rules", "array<struct<legacy_kpi:string,target_kpi:string,audit_logic:string>>")
    wide = F.from_json("rules", "struct<legacy_kpis:array<string>,target_kpis:array<string>,audit_logic:array<string>>")
    zipped = F.transform(
        F.arrays_zip(wide["legacy_kpis"], wide["target_kpis"], wide["audit_logic"]),
        lambda r: F.struct(r["legacy_kpis"].alias("legacy_kpi"), r["target_kpis"].alias("target_kpi"),
                           r["audit_logic"].alias("audit_logic")),
    )
    rules = F.when(F.col("rules").startswith("["), as_list).otherwise(zipped)
    return entries.select("company", F.posexplode(rules).alias("pos", "rule")).select(
        "company", (F.col("pos") + 1).alias("position"), "rule.legacy_kpi", "rule.target_kpi", "rule.audit_logic"
    )


def catalog_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same table from CSV files whose first column is filled only on the first row of a company.

    A file is a sheet: names are carried down within it, and rules numbered within a company of it. Both are scans in
    splits (``scans``), so a long file, or a company with most of the rules, is worked on by many tasks. Rows are placed by
    their position as read; the files are read once, into a table.
    """
    raw = written(
        spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"')
        .schema("company string, legacy_kpi string, target_kpi string, audit_logic string, note string").csv(path)
        .select("company", "legacy_kpi", "target_kpi", "audit_logic", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__pos")),
        "catalog",
    )
    filled = scans.forward_fill(raw, "company", ["__file"], "__pos")
    numbered = scans.row_numbers(filled, ["__file", "company"], "__pos")
    return numbered.select("company", "position", "legacy_kpi", "target_kpi", "audit_logic")
