"""Nested JSON documents to KPI rows and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import dims
from ledgerloom.functions import periods, units, values
from ledgerloom.functions.text import salted_hash


def json_path(keys: list[str]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def strip_code_fence(text: Column) -> Column:
    """Without a leading ```json and a trailing ``` marker; a text without any marker is not searched by the pattern.

    Trimming the end of a text costs a pass over all its characters, so only one that ends in a blank is trimmed there.
    """
    blank_end = reduce(lambda a, b: a | b, [text.endswith(blank) for blank in values.BLANKS])
    bare = F.when(blank_end, values.strip(text)).otherwise(F.ltrim(text, F.lit(values.BLANKS)))
    return F.when(bare.contains("```"), F.regexp_replace(bare, r"^```json\s*|\s*```$", "")).otherwise(bare)


def decode(text: Column) -> Column:
    """JSON text as VARIANT; text that is JSON inside a JSON string is parsed once more; objects only.

    The first character tells a string and an object apart, so each row is parsed once per level.
    """
    quoted = F.ltrim(text).startswith('"')
    inner = F.when(quoted, F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)
    return F.when(F.ltrim(inner, F.lit(values.BLANKS)).startswith("{"), F.try_parse_json(inner))


def decode_json_doc(df: DataFrame, text_col: str = "raw_json", out: str = "doc", fenced: bool = False) -> DataFrame:
    """Adds the decoded document (null when it is malformed or not an object).

    The text without its fence is a column of its own: an expression would be worked out again wherever ``decode`` looks at it.
    """
    if not fenced:
        return df.withColumn(out, decode(F.col(text_col)))
    return df.withColumn("__bare", strip_code_fence(F.col(text_col))).withColumn(out, decode(F.col("__bare"))).drop("__bare")


def decoded_only(df: DataFrame, text_col: str = "raw_json", out: str = "doc", fenced: bool = False) -> DataFrame:
    """The same without the undecodable rows.

    The parse is a column, and exploding an array of it keeps it in one place; a filter on the column itself would be
    pushed below it and parse every text twice.
    """
    parsed = decode_json_doc(df, text_col, "__parsed", fenced)
    return parsed.select("*", F.explode(F.array("__parsed")).alias(out)).drop("__parsed").filter(F.col(out).isNotNull())


def decode_or_reason(df: DataFrame, text_col: str = "raw_json", out: str = "doc", fenced: bool = False) -> DataFrame:
    """Adds the decoded document and, where there is none, the reason that ``quarantine`` gives: both from one parse."""
    bare = strip_code_fence(F.col(text_col)) if fenced else F.col(text_col)
    read = df.withColumn("__bare", bare).withColumn(out, decode(F.col("__bare")))
    why = F.when(F.try_parse_json(F.col("__bare")).isNull(), "json_error").otherwise("not_object")
    return read.withColumn("reason", F.when(F.col(out).isNull(), why)).drop("__bare")


def quarantine(df: DataFrame, text_col: str = "raw_json", fenced: bool = False) -> DataFrame:
    """The rows that ``decoded_only`` leaves out, with the reason: json_error or not_object."""
    text = F.col(text_col)
    plain = strip_code_fence(text) if fenced else text
    return df.filter(decode(plain).isNull()).withColumn(
        "reason", F.when(F.try_parse_json(plain).isNull(), "json_error").otherwise("not_object")
    )


def dig(doc: Column, keys: list[str], kind: str = "variant") -> Column:
    """Value at a path; null as soon as something on the way is not an object."""
    return F.try_variant_get(doc, json_path(keys), kind)


def _node_type(node: str = "variant", keys: list[str] = dims.KPI_KEYS) -> str:
    """Type of the metrics section with the node of each KPI as it is, or as another type."""
    sections: dict[str, list[str]] = {}
    top = []
    for key, _, path, _ in dims.KPI_REGISTRY:
        if key not in keys:
            continue
        if len(path) == 1:
            top.append(f"{path[0]}: {node}")
        else:
            sections.setdefault(path[0], []).append(f"{path[-1]}: {node}")
    return f"struct<{', '.join(top + [f'{name}: struct<{", ".join(inner)}>' for name, inner in sections.items()])}>"


def kpi_nodes(doc: Column) -> Column:
    """The nodes of all KPIs from one walk through a document; ``node_of`` takes one out."""
    return dig(doc, [dims.ROOT], _node_type())


def node_of(nodes: Column, key: str) -> Column:
    """Node of a KPI, null where ``dig`` finds none."""
    return reduce(lambda inner, name: inner[name], dims.KPI_PATHS[key][1:], nodes)


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def _scalar_text(node: Column, kind: Column | None = None) -> Column:
    """Text of a JSON scalar as the extraction code prints it (strings bare, True/False/None words)."""
    kind = F.schema_of_variant(node) if kind is None else kind
    return (
        F.when(kind == "STRING", F.try_variant_get(node, "$", "string"))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", F.initcap(F.to_json(node)))
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), F.concat(F.to_json(node), F.lit(".0")))
        .otherwise(F.to_json(node))
    )


def _kind_name(kind: Column) -> Column:
    return (
        F.when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("ARRAY"), "list")
        .otherwise("float")
    )


def missing_sections(doc: Column) -> Column:
    """Required sections a document lacks, in order (they count as empty)."""
    return F.array_compact(
        F.array(*[F.when(dig(doc, [dims.ROOT, s]).isNull(), F.lit(s)) for s in dims.REQUIRED_SECTIONS])
    )


def ensure_sections(df: DataFrame, doc: str = "doc") -> DataFrame:
    return df.withColumn("missing_sections", missing_sections(F.col(doc)))


def is_financial(doc: Column) -> Column:
    """At least one of the 12 core KPIs carries a real value."""
    return _any_financial(doc, {k: dig(doc, [*dims.KPI_PATHS[k], "value"], "string") for k in dims.CORE_FINANCIAL_KPIS})


def _any_financial(doc: Column, texts: dict[str, Column]) -> Column:
    """The values read as texts tell this at once; only that of a decimal zero (0.0 is a value, 0 is none) is not its JSON text.

    The JSON text stands behind a condition, as Spark works out both sides of an ``&`` where an expression is repeated in them.
    """

    def carries(key: str, text: Column) -> Column:
        own = values.has_financial_value(_scalar_text(dig(doc, [*dims.KPI_PATHS[key], "value"])))
        return values.has_financial_value(text) | F.when(values.strip(text) == "0", own).otherwise(False)

    return reduce(lambda a, b: a | b, [carries(k, text) for k, text in texts.items()])


def filter_financial_docs(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents that ``is_financial`` lets pass, each walked through once."""
    return with_financial(df, doc, "__financial").filter("__financial").drop("__financial")


def with_financial(df: DataFrame, doc: str = "doc", out: str = "financial") -> DataFrame:
    """Adds ``is_financial`` of each document, from one walk through it.

    Exploding an array of the values keeps the walk in one place; a filter on them would be pushed below it and walk once a KPI.
    """
    core = dig(F.col(doc), [dims.ROOT], _node_type("struct<value: string>", dims.CORE_FINANCIAL_KPIS))
    read = df.select("*", F.explode(F.array(core)).alias("__core"))
    texts = {k: node_of(F.col("__core"), k)["value"] for k in dims.CORE_FINANCIAL_KPIS}
    return read.withColumn(out, _any_financial(F.col(doc), texts)).drop("__core")


def detect_currency(doc: Column) -> Column:
    raw = dig(doc, [dims.CONTEXT, "currency"])
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
    code = F.upper(values.strip(text))
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise("USD")


def explode_kpis(docs: DataFrame, doc: str = "doc", keep: list[str] | None = None, mode: str = "reference") -> DataFrame:
    """16 rows per document in registry order, also for KPIs the document does not have.

    Adds ordinal, kpi_key, kpi_label, raw_value, numeric_value, unit, is_valid, confidence,
    source_description and node_warning. One walk through the document, no join, no shuffle; a row carries its own node only.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != doc]

    # a row carries its place and its node through the steps; what its KPI is called is looked up by its place at the end
    entries = F.array(*[F.struct(F.lit(i).alias("ordinal"), node_of(F.col("__nodes"), key).alias("node")) for i, key in enumerate(dims.KPI_KEYS, 1)])
    key, label, unit = (F.get(F.array(*column), F.col("ordinal") - 1) for column in zip(
        *[(F.lit(key), F.lit(label), units.normalize_unit(F.lit(unit))) for key, label, _, unit in dims.KPI_REGISTRY]
    ))
    rows = docs.select(*keep, kpi_nodes(F.col(doc)).alias("__nodes")).select(*keep, F.inline(entries))
    rows = rows.withColumns(
        {
            "value": dig(F.col("node"), ["value"]),
            "source_description": dig(F.col("node"), ["description"], "string"),
            "confidence": dig(F.col("node"), ["confidence"], "double"),
        }
    )
    # the type of a node is worked out only where it has no value of its own
    rows = rows.withColumn("node_kind", F.when(F.col("value").isNull() & F.col("node").isNotNull(), F.schema_of_variant("node")))
    bare = F.coalesce(~F.col("node_kind").startswith("OBJECT"), F.lit(False))
    rows = rows.select(
        *keep, "ordinal", "source_description", "confidence",
        F.when(bare, F.col("node")).otherwise(F.col("value")).alias("scalar"),
        F.when(bare, F.col("node_kind")).otherwise(F.schema_of_variant("value")).alias("kind"),
        F.when(bare & (F.col("node_kind") != "VOID"), F.col("node_kind")).alias("wrong_kind"),
    )
    read = rows.select(
        *keep,
        "ordinal",
        _scalar_text(F.col("scalar"), F.col("kind")).alias("raw_value"),
        "source_description",
        "confidence",
        F.when(
            F.col("wrong_kind").isNotNull(),
            F.concat(F.lit("KPI '"), key, F.lit("' node is not a dict: "), _kind_name(F.col("wrong_kind"))),
        ).alias("node_warning"),
    )
    parsed = values.with_parsed(read, F.col("raw_value"), "numeric_value", "__unit", mode)
    return parsed.select(
        *keep,
        "ordinal",
        key.alias("kpi_key"),
        label.alias("kpi_label"),
        "raw_value",
        "numeric_value",
        # the unit of a KPI is a constant; only that of a text is looked at
        F.when(F.col("__unit") != "", units.normalize_unit(F.col("__unit"))).otherwise(unit).alias("unit"),
        F.col("numeric_value").isNotNull().alias("is_valid"),
        "confidence",
        "source_description",
        "node_warning",
    )


def document_period(doc: Column, raw: Column, as_of_year: Column, mode: str = "reference") -> Column:
    """Period of a document from its original text (key order decides ties)."""
    declared = dig(doc, [dims.CONTEXT, "period"], "string")
    return periods.infer_period(raw, as_of_year, declared, mode)


def dashboard_extract(doc: Column) -> dict[str, Column]:
    """The six headline metric texts of a document."""
    return {k: dig(doc, [*dims.KPI_PATHS[k], "value"], "string") for k in dims.HEADLINE_KPIS}


def headline_confidences(doc: Column) -> dict[str, Column]:
    return {k: dig(doc, [*dims.KPI_PATHS[k], "confidence"], "double") for k in dims.HEADLINE_KPIS}


def visible_metrics(df: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """One row per headline metric a dashboard shows: kpi_key, raw_value, confidence."""
    keep = keep if keep is not None else [c for c in df.columns if c != doc]
    conf = headline_confidences(F.col(doc))
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("kpi_key"), text.alias("raw_value"), conf[k].alias("confidence"))
            for k, text in dashboard_extract(F.col(doc)).items()
        ]
    )
    return df.select(*keep, F.inline(entries)).filter(values.is_visible(F.col("raw_value")))


def missing_or_low_conf(df: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Headline metrics a founder must fill in: absent, not text, or confidence below 0.70."""
    keep = keep if keep is not None else [c for c in df.columns if c != doc]
    nodes = []
    for k in dims.HEADLINE_KPIS:
        value = dig(node_of(F.col("__nodes"), k), ["value"])
        conf = dig(node_of(F.col("__nodes"), k), ["confidence"])
        numeric = F.schema_of_variant(conf).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        nodes.append(
            F.struct(
                F.lit(k).alias("kpi_key"),
                F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).alias("raw_value"),
                F.when(numeric, F.try_variant_get(conf, "$", "double")).alias("confidence"),
            )
        )
    rows = df.select(*keep, kpi_nodes(F.col(doc)).alias("__nodes")).select(*keep, F.inline(F.array(*nodes)))
    return rows.filter(F.col("raw_value").isNull() | (F.col("confidence") < dims.CONF_CRITICAL))


def build_documents(kpis: DataFrame, doc_id: str, order: str = "row_seq", parts: dict[str, list[str]] | None = None) -> DataFrame:
    """KPI rows (raw_value, confidence, source_description, is_scalar) to the JSON of the metrics section.

    ``parts`` names several such texts, each with the KPIs that go into it; without it all are in ``metrics_json``.

    The first row of a repeated KPI counts; unregistered keys are not part of a document. The rows are read and shuffled
    once, as one row per document and task with its first node of each KPI, so a document of very many rows is no large group.
    """
    as_text = F.to_json(
        F.struct(
            F.col("raw_value").alias("value"), F.col("confidence"), F.col("source_description").alias("description")
        )
    )
    text = F.when(F.col("is_scalar"), json_string(F.col("raw_value"))).otherwise(as_text)
    known = F.when(F.col("kpi_key").isin(dims.KPI_KEYS), F.struct(F.col(order).alias("at"), text.alias("json")))
    nodes = kpis.select(doc_id, "kpi_key", known.alias("node"))
    firsts = nodes.groupBy(doc_id).agg(*[F.min(F.when(F.col("kpi_key") == k, F.col("node"))).alias(k) for k in dims.KPI_KEYS])
    parts = parts or {"metrics_json": dims.KPI_KEYS}
    return firsts.select(doc_id, *[metrics_json({k: F.col(k)["json"] for k in keys}).alias(name) for name, keys in parts.items()])


def json_string(text: Column) -> Column:
    """Text as a quoted JSON string; null stays null."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def metrics_json(nodes: dict[str, Column]) -> Column:
    """JSON text of the metrics section from one JSON text per KPI (null or not named = absent)."""

    sections: dict[str, list[Column]] = {}
    top: list[Column] = []
    for key, _, path, _ in dims.KPI_REGISTRY:
        if key not in nodes:
            continue
        member = F.concat(F.lit(f'"{key}":'), nodes[key])
        if len(path) == 1:
            top.append(member)
        else:
            sections.setdefault(path[0], []).append(member)
    for section, members in sections.items():
        filled = reduce(lambda a, b: a | b, [m.isNotNull() for m in members])
        top.append(F.when(filled, F.concat(F.lit(f'"{section}":{{'), F.concat_ws(",", *members), F.lit("}"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *top), F.lit("}"))


def _members(node: Column) -> Column:
    """Members of an object; null for what is none."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def _object_with(members: Column, replaced: dict[str, Column]) -> Column:
    """JSON text of an object with every member it has; those named in ``replaced`` come from there (null: absent)."""
    own = F.map_filter(members, lambda name, _: ~name.isin(*replaced))
    kept = F.transform(F.map_entries(own), lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.to_json(e["value"])))
    # texts are joined one by one: in an array of them Spark would work each out without compiled code
    added = [F.concat(F.lit(f'"{name}":'), text) for name, text in replaced.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", kept, *added), F.lit("}"))


def with_shells(df: DataFrame, doc: str) -> DataFrame:
    """Adds what ``document_with`` needs of each document, each object taken apart once: its members, those of the metrics and of
    every section."""
    names = dict.fromkeys([*[path[0] for _, _, path, _ in dims.KPI_REGISTRY if len(path) > 1], *dims.REQUIRED_SECTIONS])
    nodes = dig(F.col(doc), [dims.ROOT], f"struct<{', '.join(f'{name}: variant' for name in names)}>")
    sections = F.struct(*[_members(F.col("__sections")[name]).alias(name) for name in names])
    found = df.withColumns({"__sections": nodes, "__root": dig(F.col(doc), [dims.ROOT]), "__of_doc": _members(F.col(doc))})
    return found.withColumns({"__of_root": _members(F.col("__root")), "__of": sections})


def document_with(nodes: dict[str, Column], context: Column | None = None, sections: bool = False) -> Column:
    """JSON text of a document (of a frame ``with_shells``) whose registry KPIs are the given JSON texts (null: absent); all else is kept.

    A section that is no object is replaced only where a KPI goes into it. ``sections`` adds the required ones, empty.
    """
    top: dict[str, Column] = {}
    inside: dict[str, dict[str, Column]] = {name: {} for name in dims.REQUIRED_SECTIONS if sections}
    for key, _, path, _ in dims.KPI_REGISTRY:
        if len(path) == 1:
            empty = F.lit("{}") if sections and path[0] in dims.REQUIRED_SECTIONS else F.lit(None).cast("string")
            top[path[0]] = F.coalesce(nodes[key], empty)
        else:
            inside.setdefault(path[0], {})[path[-1]] = nodes[key]
    for section, members in inside.items():
        if section in top:
            continue
        node, own = F.col("__sections")[section], F.col("__of")[section]
        filled = F.lit(False)
        for text in members.values():
            filled = filled | text.isNotNull()
        whole = own.isNotNull() | filled | (F.lit(sections and section in dims.REQUIRED_SECTIONS) & node.isNull())
        top[section] = F.when(whole, _object_with(own, members or {"": F.lit(None).cast("string")})).otherwise(F.to_json(node))
    text = _object_with(F.col("__of_root"), top)
    metrics = F.when(F.col("__of_root").isNotNull() | (text != "{}"), text).otherwise(F.to_json(F.col("__root")))
    replaced = {dims.ROOT: metrics} | ({} if context is None else {dims.CONTEXT: context})
    return _object_with(F.col("__of_doc"), replaced)


def patch_document(docs: DataFrame, patches: DataFrame, doc_id: str, doc: str = "doc") -> DataFrame:
    """Replace single metric values, leaving every sibling as it is.

    ``patches``: doc_id, kpi_key, value -- one row per metric. The patches of a document
    are turned into at most 16 columns and joined once; each document is rebuilt with all its
    members. A rebuilt text that is not JSON stops the query.
    """
    wide = patches.groupBy(doc_id).agg(
        *[F.max(F.when(F.col("kpi_key") == k, F.col("value"))).alias("p_" + k) for k in dims.KPI_KEYS]
    )
    joined = with_shells(docs.join(wide, doc_id, "left").withColumn("__nodes", kpi_nodes(F.col(doc))), doc)
    nodes, patched = {}, F.lit(False)
    for k in dims.KPI_KEYS:
        old = node_of(F.col("__nodes"), k)
        new = F.col("p_" + k)
        nodes[k] = F.when(new.isNotNull(), _object_with(_members(old), {"value": json_string(new)})).otherwise(F.to_json(old))
        patched = patched | new.isNotNull()
    text = F.when(F.col(doc).isNotNull(), document_with(nodes))
    return joined.withColumn(doc, F.when(patched, F.parse_json(text)).otherwise(F.col(doc))).select(*docs.columns)


MANUAL_NOTE = "Entrada manual del Analista"  # fixed value


def manual_entry(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Wide form entries (16 nullable KPI columns) as KPI rows with full confidence."""
    clean = wide.select(*ids, *[values.nullif_blank(F.col(k).cast("string")).alias(k) for k in dims.KPI_KEYS])
    return clean.unpivot(ids, dims.KPI_KEYS, "kpi_key", "raw_value").withColumns(
        {
            "confidence": F.lit(1.0),
            "source_description": F.lit(MANUAL_NOTE),
            "original_currency": F.lit("USD"),
        }
    )


def manual_documents(wide: DataFrame, salt: Column | None = None) -> DataFrame:
    """Wide form entries as documents ready for ``ingest.build_contracts``: header columns, document (VARIANT) and its text.

    ``wide``: company_id, period_id, portfolio_id, founder_email, submitted_at and the 16 KPI columns (any of them null or
    blank). The node tree is built as a struct and turned into a VARIANT and a text, so nothing is parsed. The hash is
    that of company, period and ``salt`` (default: random, so that a repeated entry is not a copy).
    """
    clean = coerce_manual_fields(wide, dims.KPI_KEYS)
    direct: list[Column] = []
    sections: dict[str, list[Column]] = {}
    for key, _, path, _ in dims.KPI_REGISTRY:
        node = F.struct(F.col(key).alias("value"), F.lit(1.0).alias("confidence"), F.lit(MANUAL_NOTE).alias("description")).alias(path[-1])
        if len(path) == 1:
            direct.append(node)
        else:
            sections.setdefault(path[0], []).append(node)
    metrics = F.struct(*direct, *[F.struct(*members).alias(name) for name, members in sections.items()])
    context = F.struct(F.lit("USD").alias("currency"), F.col("period_id").alias("period"), F.lit("units").alias("scale"), F.lit(MANUAL_NOTE).alias("scale_notes"))
    tree = F.struct(context.alias(dims.CONTEXT), metrics.alias(dims.ROOT))
    hashed = clean.withColumn("file_hash", salted_hash(F.col("company_id"), F.col("period_id"), salt))
    return hashed.select(
        F.concat(F.lit("M"), "file_hash").alias("submission_id"),
        "file_hash", "company_id", "founder_email",
        F.concat(F.lit("[manual] "), "company_id", F.lit(" "), "period_id").alias("original_filename"),
        "submitted_at", "portfolio_id",
        F.to_variant_object(tree).alias("doc"),
        F.to_json(tree, {"ignoreNullFields": "false"}).alias("raw_json"),
    )


def coerce_manual_fields(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Blank texts to null and numbers to text, for the given columns."""
    return wide.withColumns({c: values.nullif_blank(F.col(c).cast("string")) for c in columns})


def merge_chunks(rows: DataFrame, doc_id: str = "doc_id", chunk: str = "chunk_id", tie: str = "seq") -> DataFrame:
    """Several partial extractions to one value per KPI: highest confidence, then the lowest chunk.

    Rows without a value never win over one with a value; null confidence counts as 0.
    Ranking with a limit of one lets Spark keep a single candidate per group before the shuffle.
    """
    order = Window.partitionBy(doc_id, "kpi_key").orderBy(
        F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), F.col(chunk), F.col(tie)
    )
    best = rows.filter(F.col("raw_value").isNotNull()).withColumn("__rank", F.row_number().over(order))
    return best.filter(F.col("__rank") == 1).drop("__rank")


def merge_chunk_documents(chunks: DataFrame, doc_id: str = "doc_id", chunk: str = "chunk_id", doc: str = "doc",
                          mode: str = "reference") -> DataFrame:
    """Chunk documents to merged documents: doc_id and raw_json.

    The first chunk's document with all its members, the best node of each KPI, and the required
    sections. A scalar of the first chunk survives only when no chunk has an object with a value.
    The context comes from the first chunk (``intended``: from the first chunk that has one).

    Chunks are read and shuffled once: a task hands on one row per document, with its best node of each KPI and its first chunk.
    """

    def node(key: str) -> Column:
        """JSON text of the node, and its place: objects with a value by falling confidence, then the rest; by chunk."""
        found = node_of(F.col("__nodes"), key)
        value = dig(found, ["value"])  # only an object has one
        has_value = value.isNotNull() & ~F.is_variant_null(value)
        rank = F.when(has_value, F.coalesce(dig(found, ["confidence"], "double"), F.lit(0.0)))
        # nan is above all numbers, as in a falling order
        place = F.struct(~has_value, F.coalesce(~F.isnan(rank), F.lit(True)), -rank, F.col(chunk))
        return F.struct(F.to_json(found).alias("json"), place.alias("place"))

    first = F.struct(F.col(chunk).alias("chunk"))
    found = chunks.select(doc_id, chunk, F.col(doc).alias("__doc"), kpi_nodes(F.col(doc)).alias("__nodes"))
    read = found.select(doc_id, "__doc", first.alias("__first"), *[node(k).alias(k) for k in dims.KPI_KEYS])
    best = [F.min_by(F.col(k)["json"], F.col(k)["place"]).alias(k) for k in dims.KPI_KEYS]
    context = None
    if mode == "intended":
        own = F.to_json(dig(F.col("__doc"), [dims.CONTEXT]))
        best.append(F.min_by(own, F.when(own.isNotNull(), F.col("__first"))).alias("__context"))
        context = F.col("__context")
    merged = read.groupBy(doc_id).agg(F.min_by("__doc", F.col("__first")).alias("__doc"), *best)
    text = document_with({k: F.col(k) for k in dims.KPI_KEYS}, context, sections=True)
    return with_shells(merged, "__doc").select(doc_id, F.when(F.col("__doc").isNotNull(), text).alias("raw_json"))


PAGES_PER_CHUNK = 90


def page_blocks(pages: DataFrame, doc_id: str, page_no: str = "page_no", size: int = PAGES_PER_CHUNK) -> DataFrame:
    """Blocks of ``size`` pages: document, block, first and last page (pages are numbered from 1)."""
    return (
        pages.groupBy(doc_id, F.floor((F.col(page_no) - 1) / size).alias("block"))
        .agg(F.min(page_no).alias("first_page"), F.max(page_no).alias("last_page"))
    )


def assign_chunks(
    pages: DataFrame, doc_id: str, order_by: str, size: int = PAGES_PER_CHUNK, bucket_width: int = 100_000
) -> DataFrame:
    """Number the pages of every document by an integer column and cut them into blocks.

    Numbering is two-step so that one huge document is not one task: pages are ranked
    inside id ranges of ``bucket_width`` (at most that many rows each), and the small
    counts per range give the offsets.
    """
    bucketed = pages.select(doc_id, order_by, F.floor(F.col(order_by) / bucket_width).alias("__bucket"))
    counts = bucketed.groupBy(doc_id, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(doc_id).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        doc_id, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    local = Window.partitionBy(doc_id, "__bucket").orderBy(order_by)
    numbered = bucketed.withColumn("__rank", F.row_number().over(local)).join(offsets, [doc_id, "__bucket"])
    page_no = F.col("__rank") + F.col("__offset")
    return page_blocks(numbered.select(doc_id, page_no.alias("page_no")), doc_id, "page_no", size)
