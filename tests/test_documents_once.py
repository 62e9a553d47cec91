"""Documents are built, decoded and merged in one pass over their rows, with the same results."""

import json

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.operators import documents
from ledgerloom.session import tune


def exchanges(frame):
    return frame._jdf.queryExecution().sparkPlan().toString(), frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_documents_are_built_with_one_shuffle(spark, tmp_path):
    rows = [("a", 2, "revenue", "2", False), ("a", 1, "revenue", "1", False), ("a", 3, "cogs", "7", True), ("b", 1, "other", "9", False), ("c", 1, "cogs", None, True)]
    spark.createDataFrame(rows, "id string, row_seq int, kpi_key string, raw_value string, is_scalar boolean").withColumns(
        {"confidence": F.lit(0.5), "source_description": F.lit(None).cast("string")}).write.parquet(str(tmp_path / "k"))
    built = documents.build_documents(spark.read.parquet(str(tmp_path / "k")), "id")
    plan, shuffles = exchanges(built)
    assert plan.count("FileScan") == 1 and shuffles == 1
    got = {r[0]: json.loads(r[1]) for r in built.collect()}
    assert got == {"a": {"base_metrics": {"revenue": {"value": "1", "confidence": 0.5}, "cogs": "7"}}, "b": {}, "c": {}}


def chunk(value, confidence):
    return json.dumps({"financial_metrics_2025": {"base_metrics": {"revenue": {"value": value, "confidence": confidence}}}})


def test_chunks_are_merged_with_one_shuffle(spark, tmp_path):
    rows = [("x", 2, chunk("two", 0.9)), ("x", 1, chunk("one", 0.9)), ("x", 0, chunk("zero", 0.1)), ("n", 0, chunk("top", 5.0)), ("n", 1, chunk("nan", "NaN")),
            ("s", 1, json.dumps({"financial_metrics_2025": {"base_metrics": {"revenue": "late"}}})), ("s", 0, json.dumps({"kept": 1})), ("v", 0, chunk(None, 0.9)), ("v", 1, chunk("low", None))]
    spark.createDataFrame(rows, "doc_id string, chunk_id int, text string").write.parquet(str(tmp_path / "c"))
    merged = documents.merge_chunk_documents(documents.decoded_only(spark.read.parquet(str(tmp_path / "c")), "text"))
    plan, shuffles = exchanges(merged)
    assert plan.count("FileScan") == 1 and shuffles == 1
    out = {r[0]: json.loads(r[1]) for r in merged.collect()}
    value = {k: (d["financial_metrics_2025"]["base_metrics"].get("revenue") or {}).get("value") for k, d in out.items()}
    assert value == {"x": "one", "n": "nan", "s": None, "v": "low"}
    assert out["s"]["kept"] == 1


def test_decoding_is_whole_stage_code_without_the_fence_repeated(spark):
    texts = spark.range(3).select(F.concat(F.lit('```json\n{"a":'), F.col("id").cast("string"), F.lit("}\n```")).alias("raw_json"))
    found = documents.decoded_only(texts, fenced=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("lambda") == 0
    assert sorted(r[0] for r in found.select(documents.dig(F.col("doc"), ["a"], "int")).collect()) == [0, 1, 2]


def test_documents_and_reasons_from_one_parse(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a": 1}', "[1]", '{"a"', '"{}"', None, "```json\n{}\n```"])], "id int, raw_json string")
    read = documents.decode_or_reason(texts, fenced=True)
    assert {r["id"] for r in read.filter("reason IS NULL").collect()} == {r["id"] for r in documents.decoded_only(texts, fenced=True).collect()}
    want = {(r["id"], r["reason"]) for r in documents.quarantine(texts, fenced=True).collect()}
    assert {(r["id"], r["reason"]) for r in read.filter("reason IS NOT NULL").collect()} == want


def test_gate_looks_at_values_as_before(spark):
    values = ['"5"', "0", "0.0", '"0"', '"N/A"', "true", "null", "[]", "{}", "1.5", '" none "', "0e5", '"0.0"']
    texts = spark.createDataFrame([(i, f'{{"financial_metrics_2025":{{"base_metrics":{{"revenue":{{"value":{v}}}}}}}}}') for i, v in enumerate(values)], "id int, raw_json string")
    found = documents.decoded_only(texts).withColumn("text", documents._scalar_text(documents.dig(F.col("doc"), ["financial_metrics_2025", "base_metrics", "revenue", "value"])))
    slow = documents.values.has_financial_value(F.col("text"))
    rows = found.select("id", documents.is_financial(F.col("doc")).alias("fast"), slow.alias("slow")).collect()
    assert len(rows) == len(values) and all(r["fast"] == r["slow"] for r in rows)
    assert "exists" not in documents.is_financial(F.col("doc"))._jc.toString().lower()


def test_exploded_rows_do_not_carry_their_document(spark):
    texts = spark.createDataFrame([("a", chunk("5K", 0.5)), ("b", '{"financial_metrics_2025": {"base_metrics": {"revenue": 7}}}'), ("c", '{"financial_metrics_2025": 1}')], "id string, raw_json string")
    rows = documents.explode_kpis(documents.decoded_only(texts), "doc", ["id"])
    generated = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate inline" in line]
    assert len(generated) == 1 and "__doc" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["raw_value"], r["numeric_value"], r["unit"], r["node_warning"]) for r in rows.filter("kpi_key = 'revenue'").collect()}
    assert got == {"a": ("5K", 5000.0, "K", None), "b": ("7", 7.0, "$", "KPI 'revenue' node is not a dict: int"), "c": (None, None, "$", None)}
    assert rows.count() == 48


def test_tasks_get_partitions_of_bounded_size(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        for given, kept in (("64MB", str(8 << 20)), ("16k", "16k")):
            spark.conf.set(size, given)
            assert tune(spark).conf.get(size) == kept
    finally:
        spark.conf.set(size, before)


def test_gate_walks_through_a_document_once(spark):
    nodes = ['{"value":"5"}', '{"value":0}', '{"value":0.0}', '{"value":"0"}', '{"value":[]}', '{"value":{"a":1}}', '{"value":null}', '{"value":true}', '"5"', "[1]", "null", "{}"]
    sections = [f'{{"{path[0]}":{n}}}' if len(path) == 1 else f'{{"{path[0]}":{{"{path[1]}":{n}}}}}' for path in (dims.KPI_PATHS[k] for k in dims.CORE_FINANCIAL_KPIS) for n in nodes]
    texts = [f'{{"{dims.ROOT}":{s}}}' for s in [*sections, '{"base_metrics":[1]}', "[]", "null", '"x"', "{}"]] + ["{}"]
    found = documents.decoded_only(spark.createDataFrame(list(enumerate(texts)), "id int, raw_json string"))
    passed = documents.filter_financial_docs(found)
    assert passed.columns == found.columns
    assert {r[0] for r in passed.select("id").collect()} == {r[0] for r in found.filter(documents.is_financial(F.col("doc"))).select("id").collect()}
    plan = passed._jdf.queryExecution().optimizedPlan().toString()
    assert "['value'], StringType" not in plan
