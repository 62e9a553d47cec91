"""Companies, funds, sectors and exchange rates looked up for rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import dims
from ledgerloom.functions import formats, values
from ledgerloom.operators.skew import attach_by_key, row_hash, written


def _first_match(names: list[tuple[str, str]], test, result) -> Column:
    """Result for the first name that passes; one CASE branch per registry name."""
    branches = [F.when(test(name), F.lit(result(name, info))) for name, info in names]
    return F.coalesce(*branches) if branches else F.lit(None).cast("string")


def _squeeze(company: Column) -> Column:
    return F.translate(F.lower(company), ".-_", "")


def lookup_portfolio(company: Column, names: list[tuple[str, str]] | None = None) -> Column:
    """Fund of the first registry name contained in the id (without . - _), else ``unknown``."""
    names = dims.portfolio_names() if names is None else names
    squeezed = _squeeze(company)
    found = _first_match(names, lambda n: squeezed.contains(n.replace("-", "")), lambda n, fund: fund)
    return F.coalesce(found, F.lit("unknown"))


def company_bucket_substr(company: Column, names: list[tuple[str, str]] | None = None) -> Column:
    """Sector of the first registry name contained in the id, else ``UNKNOWN``."""
    names = dims.bucket_names() if names is None else names
    squeezed = _squeeze(company)
    found = _first_match(names, squeezed.contains, lambda n, bucket: bucket)
    return F.coalesce(found, F.lit("UNKNOWN"))


def detect_company(text: Column, names: list[tuple[str, str]] | None = None) -> Column:
    """struct(company_key, portfolio_id) of the longest registry name found in the whole text.

    A name counts when it is in the lower-cased text, in the text with separators collapsed,
    or in the text reduced to letters and digits.
    """
    names = dims.portfolio_names() if names is None else names
    longest_first = sorted(names, key=lambda pair: -len(pair[0]))
    lower = F.lower(text)
    spaced = F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))
    packed = F.regexp_replace(lower, "[^a-z0-9]+", "")

    def found(name: str) -> Column:
        bare = "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())
        tests = [lower.contains(name), packed.contains(bare)]
        if bare != name:
            tests.insert(1, spaced.contains(name))
        # a pure letter-digit name found in the raw or spaced text is also in the packed text
        return packed.contains(bare) if bare == name else reduce(lambda a, b: a | b, tests)

    key = F.coalesce(_first_match(longest_first, found, lambda n, fund: n), F.lit("unknown"))
    funds = F.create_map(*[F.lit(x) for pair in names for x in pair], F.lit("unknown"), F.lit("unknown"))
    return F.struct(key.alias("company_key"), F.try_element_at(funds, key).alias("portfolio_id"))


def company_label(email: Column, filename: Column, names: list[str] | None = None, mode: str = "reference") -> Column:
    """Company shown for a result: matched by e-mail domain, else by the first file-name word.

    A candidate matches when it contains a name or is contained in one; in ``reference`` mode
    an empty domain is "contained" in the first name, ``intended`` skips empty candidates.
    """
    names = [n.capitalize() for n, _ in dims.portfolio_names()] if names is None else names
    mail_host = F.coalesce(F.get(F.split(email, "@", -1), F.lit(1)), F.lit(""))
    domain = F.get(F.split(mail_host, r"\.", -1), F.lit(0))
    word = F.get(F.split(F.regexp_replace(filename, r"^[a-f0-9]+_", ""), r"[_.\s-]", -1), F.lit(0))

    def match(candidate: Column) -> Column:
        lower = F.lower(candidate)
        hit = F.coalesce(
            *[
                F.when(lower.contains(n.lower()) | F.lit(n.lower()).contains(lower), F.lit(n))
                for n in names
            ]
        )
        return F.when(candidate != "", hit) if mode == "intended" else hit

    first_up = F.concat(F.upper(F.substring(domain, 1, 1)), F.substring(domain, F.lit(2), F.length(domain)))
    fallback = F.when(domain != "", first_up).when(word != "", word).otherwise("Desconocido")
    return F.coalesce(match(domain), match(word), fallback)


def normalize_company(rows: DataFrame, dim: DataFrame, company: str = "company_id", key: str = "company_key",
                      out: str = "company_key") -> DataFrame:
    """Canonical key of every raw company id, against a company table of any size.

    Exact id (lower case, up to the first dot), else without - and _, else the longest key
    followed by - or _ at the start, else the squeezed id. The prefix rule is turned into
    equality: an id has only as many candidate prefixes as it has separators, so distinct
    ids are exploded to their candidates and joined by key.
    """
    rows = written(rows, "rows")
    distinct = rows.groupBy(company).agg(F.count(F.lit(1)).alias("__rows"))
    base = F.substring_index(F.lower(F.col(company)), ".", 1)
    squeezed = F.translate(base, "-_", "")
    cuts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(base), F.lit(1))),
        lambda i: F.substring(base, i, F.lit(1)).isin("-", "_"),
    )
    prefixes = F.transform(
        cuts, lambda i: F.struct(F.struct(F.lit(2).alias("tier"), (-i).alias("longest")).alias("rank"), F.substring(base, F.lit(1), i - 1).alias("k"))
    )
    candidates = F.concat(
        F.array(
            F.struct(F.struct(F.lit(0).alias("tier"), F.lit(0).alias("longest")).alias("rank"), base.alias("k")),
            F.struct(F.struct(F.lit(1).alias("tier"), F.lit(0).alias("longest")).alias("rank"), squeezed.alias("k")),
        ),
        prefixes,
    )
    keys = dim.select(F.col(key).alias("__k")).distinct()
    exploded = distinct.select(company, "__rows", squeezed.alias("__squeezed"), F.inline(candidates))
    best = (
        exploded.join(keys, exploded["k"] == keys["__k"], "left")
        .groupBy(company)
        .agg(
            F.min_by("__k", F.when(F.col("__k").isNotNull(), F.col("rank"))).alias("__best"),
            F.max("__squeezed").alias("__fallback"),
            F.max("__rows").alias("__rows"),
        )
        .select(company, "__rows", F.coalesce("__best", "__fallback").alias(out))
    )
    return attach_by_key(rows, best, [company], weight="__rows", staged=True).drop("__rows")


def bucket_of(key: Column) -> Column:
    """Sector of a canonical company key, ``UNKNOWN`` for others."""
    pairs = F.create_map(*[F.lit(x) for pair in dims.bucket_names() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit("UNKNOWN"))


def fx_rate_join(rows: DataFrame, rates: DataFrame | None = None, currency: str = "currency",
                 year: str = "report_year", out: str = "fx_rate") -> DataFrame:
    """Rate of (currency, year), else of the nearest year (the earlier one on a tie); unknown currency: null.

    The built-in rates have no gaps, so clamping the year to the currency's range turns the
    nearest-year rule into a plain equi join. For a table passed in see ``table_rate_join``.
    """
    code = F.upper(values.strip(F.col(currency)))
    if rates is None:
        table = F.broadcast(dims.dim_fx(rows.sparkSession)).select(
            F.col("currency").alias("__cur"), F.col("year").alias("__year"), F.col("rate").alias(out)
        )
        last = F.when(code == "USD", max(dims.USD_YEARS)).otherwise(
            dims.FX_FIRST_YEAR + len(next(iter(dims.FX_RATES.values()))) - 1
        )
        clamped = F.greatest(F.lit(dims.FX_FIRST_YEAR), F.least(last, F.col(year)))
        return rows.join(table, (code == F.col("__cur")) & (clamped == F.col("__year")), "left").drop("__cur", "__year")
    return table_rate_join(rows, rates, code, F.col(year), out)


def nearest_years(rates: DataFrame) -> DataFrame:
    """(code, asked, rate): the rate of every year between the table's first and last, from the nearest year that has one.

    Each rate stands for the years nearer to its own than to its neighbours' (the earlier one on a tie), the first and
    the last of a currency also for all years beyond: one range for each rate, unfolded into its years.
    """
    own = rates.groupBy(F.upper(values.strip(F.col("currency"))).alias("code"), F.col("year").cast("int").alias("year")).agg(F.min("rate").alias("rate"))
    own = own.filter("code IS NOT NULL AND year IS NOT NULL AND rate IS NOT NULL")
    series = Window.partitionBy("code").orderBy("year")
    lowest, highest = _year_limits(rates)
    ranged = own.withColumns({"before": F.lag("year").over(series), "after": F.lead("year").over(series)})
    first = F.coalesce(F.floor((F.col("before") + F.col("year")) / 2).cast("int") + 1, lowest)
    last = F.coalesce(F.floor((F.col("year") + F.col("after")) / 2).cast("int"), highest)
    return ranged.select("code", F.explode(F.sequence(first, last)).alias("asked"), "rate")


def _year_limits(rates: DataFrame) -> tuple[Column, Column]:
    """First and last year of a rates table, as scalar subqueries."""
    year = F.col("year").cast("int")
    return rates.select(F.min(year)).scalar(), rates.select(F.max(year)).scalar()


def table_rate_join(rows: DataFrame, rates: DataFrame, code: Column, year: Column, out: str) -> DataFrame:
    """As-of join: every row with the rate of its currency in the year nearest to its own (null: unknown currency or no year).

    Rates are unfolded to one row a year, so rows meet them by equality. A currency may hold most of the rows: rates
    are repeated for as many salts as there are shuffle partitions, and rows are dealt over them by a hash of the row. Nothing is
    broadcast by hint.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    table = nearest_years(rates).select(F.col("code").alias("__code"), F.col("asked").alias("__asked"), F.col("rate").alias(out), salted)
    lowest, highest = _year_limits(rates)
    asked = F.when(year.isNotNull(), F.greatest(lowest, F.least(highest, year)))
    left = rows.withColumns({"__of": code, "__ask": asked, "__part": F.pmod(row_hash(rows), F.lit(salts)).cast("int")})
    joined = left.join(table, (F.col("__of") == F.col("__code")) & (F.col("__ask") == F.col("__asked")) & (F.col("__part") == F.col("__salt")), "left")
    return joined.drop("__of", "__ask", "__part", "__code", "__asked", "__salt")


def fx_normalize(rows: DataFrame, rates: DataFrame | None = None, value: str = "numeric_value",
                 currency: str = "currency", year: str = "report_year", mode: str = "reference") -> DataFrame:
    """Adds fx_rate and normalized_value_usd.

    USD keeps the value and rate 1. ``intended`` converts monetary KPIs only (kpi_key needed);
    ``reference`` also divides percentages.
    """
    rated = fx_rate_join(rows, rates, currency, year, "__rate")
    usd = F.col(currency) == "USD"
    rate = F.when(F.col(value).isNotNull(), F.when(usd, F.lit(1.0)).otherwise(F.col("__rate")))
    converted = F.when(usd, F.col(value)).otherwise(F.round(F.try_divide(F.col(value), F.col("__rate")), 6))
    if mode == "intended":
        money = F.col("kpi_key").isin(dims.MONETARY_KPIS)
        rate, converted = F.when(money, rate), F.when(money, converted)
    return rated.withColumns({"fx_rate": rate, "normalized_value_usd": converted}).drop("__rate")


def to_usd(rows: DataFrame, amount: str, rates: DataFrame | None = None, currency: str = "currency",
           year: str = "report_year", out: str = "usd") -> DataFrame:
    """Stand-alone conversion: rounded to 6 places, null for an unknown currency or a zero rate."""
    rated = fx_rate_join(rows, rates, currency, year, "__rate")
    return rated.withColumn(out, F.round(F.try_divide(F.col(amount), F.col("__rate")), 6)).drop("__rate")


def to_usd_display(rows: DataFrame, raw: str = "raw_value", rates: DataFrame | None = None,
                   currency: str = "currency", year: str = "report_year", out: str = "display") -> DataFrame:
    """Displayed text: converted and reformatted for monetary KPIs of non-USD documents, else as is."""
    rated = fx_rate_join(rows, rates, currency, year, "__rate")
    converted = formats.format_usd(F.try_divide(values.parse_scaled_display(F.col(raw)), F.col("__rate")))
    applies = F.col("kpi_key").isin(dims.MONETARY_KPIS) & (F.col(currency) != "USD")
    return rated.withColumn(out, F.coalesce(F.when(applies, converted), F.col(raw))).drop("__rate")


def supported_currencies(rates: DataFrame) -> DataFrame:
    return rates.select("currency").distinct().orderBy("currency")


def join_fact_submission(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    """Facts with their submission; an equi join Spark may re-plan (skew split, broadcast) at run time."""
    return facts.join(submissions, "submission_id")


def orphan_companies(facts: DataFrame, submissions: DataFrame, dim: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct (submission, kpi, company, fund) whose company is not in the company table.

    Submissions are filtered first: only orphans meet the facts.
    """
    orphans = submissions.join(dim, submissions["company_id"] == dim["company_key"], "left_anti").select(
        "submission_id", "company_id", "portfolio_id"
    )
    found = facts.select("submission_id", "kpi_key").join(orphans, "submission_id").distinct()
    return found.orderBy("company_id", "kpi_key") if ordered else found


def orphan_kpi_rows(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    return facts.join(submissions.select("submission_id"), "submission_id", "left_anti")


def metric_dim_join(facts: DataFrame) -> DataFrame:
    """Facts with their metric definition; ``metric_bucket`` is null for an unknown metric."""
    return facts.join(F.broadcast(dims.dim_metric(facts.sparkSession)), "kpi_key", "left")


def wrong_bucket(bucket: str = "bucket_id") -> Column:
    """Another sector's metric with a confidence above 0.95."""
    return (
        (F.col("metric_bucket") != "ALL")
        & (F.col(bucket) != "UNKNOWN")
        & (F.col("metric_bucket") != F.col(bucket))
        & (F.col("confidence") > dims.CONF_BUCKET_MISMATCH)
    )


def bucket_mismatch(rows: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """Rows (with metric_bucket) that break the sector rule."""
    return rows.filter(wrong_bucket(bucket))


def dim_identity_join(submissions: DataFrame, dim: DataFrame, key: str = "company_key") -> DataFrame:
    """Adds in_dim_company, bucket_in_db to submissions that carry a canonical key."""
    lookup = dim.select(F.col("company_key").alias("__key"), F.col("bucket_id").alias("bucket_in_db"))
    joined = submissions.join(lookup, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("in_dim_company", F.col("__key").isNotNull()).drop("__key")


#: Companies without rules, and default rules, that meet in one cell of the grid at most.
CELL_ROWS = 2_000


def catalog_with_default(companies: DataFrame, catalog: DataFrame, default: str = "Standard_KPIs") -> DataFrame:
    """Catalogue rules of each company, or the default set when it has none.

    Every company without rules gets every default rule, and both sides may be of any size: they are dealt into parts
    of some CELL_ROWS rows by a hash of the row, as many parts as their counts ask for, and meet in the cells of that
    grid. Neither passes through one task, one value or the driver; a short default set is one part, so that
    companies are not copied.
    """
    columns = [c for c in catalog.columns if c != "company"]
    own = catalog.filter(F.col("company") != default)
    known = own.select("company").distinct()
    named = companies.join(own, "company").withColumn("rule_set", F.col("company"))
    others = written(companies.join(known, "company", "left_anti"), "companies")
    rules = written(catalog.filter(F.col("company") == default).select(*columns), "rules")
    across, down = (max(1, -(-side.count() // CELL_ROWS)) for side in (others, rules))

    def dealt(side: DataFrame, name: str, parts: int, other: str, copies: int) -> DataFrame:
        spread = side.withColumn(name, F.pmod(row_hash(side), F.lit(parts)).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    met = dealt(others, "__of", across, "__to", down).join(dealt(rules, "__to", down, "__of", across), ["__of", "__to"])
    unfolded = met.select(*companies.columns, F.lit(default).alias("rule_set"), *columns)
    return named.select(unfolded.columns).union(unfolded)


def nearest_rank(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key; the limit is applied before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")
