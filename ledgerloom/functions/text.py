"""File names, e-mail domains, labels and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.dims import KPI_DISPLAY_LABELS

# File types an upload may have.
SUPPORTED_EXTENSIONS = [".pdf", ".csv", ".xlsx", ".xls", ".parquet", ".docx", ".doc"]


def clean_filename(name: Column) -> Column:
    """Blanks to "_", "&" to "and", no ",()" and only the last dot kept."""
    spaced = F.translate(F.replace(name, F.lit("&"), F.lit("and")), " ,()", "_")
    return F.regexp_replace(spaced, r"\.(?=[\s\S]*\.)", "_")


def safe_filename(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def strip_hash_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^[a-f0-9]+_", "")


def truncate_filename(name: Column, limit: int = 30) -> Column:
    """Shorten to about ``limit`` characters, keeping the extension."""
    extension = F.substring_index(name, ".", -1)
    has_dot = name.contains(".")
    stem = F.when(has_dot, F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1)).otherwise("")
    room = F.lit(limit - 4) - F.length(extension)
    short = F.concat(F.substring(stem, F.lit(1), F.greatest(room, F.lit(0))), F.lit("..."), extension)
    return F.when((F.length(name) <= limit) | (F.length(stem) <= room), name).otherwise(short)


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of the base name do not count."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))


def supported_file(name: Column) -> Column:
    return F.coalesce(file_extension(name).isin(SUPPORTED_EXTENSIONS), F.lit(False))


def company_domain(company_id: Column, email: Column) -> Column:
    """Header id, else the part after the last "@", else ``pending_detection``."""
    from_mail = F.when(email.contains("@"), F.substring_index(email, "@", -1))
    found = F.coalesce(F.when(company_id != "", company_id), from_mail)
    return F.when(found.isNull() | found.isin("", "unknown"), "pending_detection").otherwise(found)


def company_from_path(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("unknown")


def title_kpi_label(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KPI_DISPLAY_LABELS.items() for x in pair])
    words = F.replace(key, F.lit("_"), F.lit(" "))
    titled = F.array_join(
        F.transform(
            F.split(words, " ", -1),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
        ),
        " ",
    )
    return F.coalesce(F.try_element_at(known, key), titled)


def capitalize(name: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))


def file_hash(content: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(content, 256), 1, length)


def salted_hash(company: Column, period: Column, salt: Column | None = None) -> Column:
    """Hash of company, period and a salt; with the default random salt it never repeats."""
    return file_hash(F.concat_ws(":", company, period, F.uuid() if salt is None else salt))
