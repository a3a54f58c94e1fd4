"""Lists of codes: rows of published files as codes of one form, and the checks that a code must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_text, squeezed, synonyms

CODE = ["code_system", "code_value", "grouping_code", "display_name", "entity_type", "search_text", "synonyms", "library_version", "country_code"]
# fixed values: entity types that a code may have
ENTITY_TYPES = ["vital_sign", "lab_result", "physical_finding", "medication", "procedure", "observation", "allergy", "condition"]


def filled(v: Column) -> Column:
    """The trimmed value, null where nothing is left."""
    return F.nullif(F.trim(v), F.lit(""))


def class_type(v: Column) -> Column:
    """The entity type of a laboratory class by how it begins."""
    c = F.upper(v)
    return (
        F.when(c.rlike(r"^(BP|HRTRATE|BODY\.TEMP|RESP)"), "vital_sign")
        .when(c.rlike("^(CHEM|HEMATOLOGY|MICRO|DRUG|TOX|SERO|PATH|BLOODGAS|COAG)"), "lab_result")
        .when(c.rlike("^(PHENOTYPE|H&P)"), "physical_finding").otherwise("observation")
    )


def _code(rows: DataFrame, columns: dict[str, Column], version: str, keep: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    given = {"grouping_code": none, "synonyms": F.array().cast("array<string>"), "library_version": F.lit(version),
        "country_code": F.lit("AUS")} | columns
    return rows.select(*(given[c].alias(c) for c in CODE), *keep)


def laboratory_codes(rows: DataFrame, version: str, keep: list[str] | None = None) -> DataFrame:
    """Codes of a LOINC table (S01, F21): panels, and rows without a number or any name, are left out."""
    name = F.coalesce(*(filled(F.col(c)) for c in ("LONG_COMMON_NAME", "SHORTNAME", "COMPONENT")))
    told = synonyms(F.coalesce("RELATEDNAMES2", F.lit("")))
    first_ten = F.filter(F.slice(told, 1, 10), lambda s: (F.length(s) > 2) | F.upper(s).isin("BP", "HR", "A1C"))
    sought = squeezed(F.replace(search_text(name, F.coalesce("COMPONENT", F.lit("")), F.coalesce("SYSTEM", F.lit("")), first_ten), F.lit(";"),
        F.lit(" ")))
    good = rows.where(filled(F.col("LOINC_NUM")).isNotNull() & ~F.coalesce(F.upper("CLASS").contains("PANEL"), F.lit(False)) & name.isNotNull())
    columns = {"code_system": F.lit("loinc"), "code_value": F.trim("LOINC_NUM"), "display_name": name,
        "entity_type": class_type(F.coalesce("CLASS", F.lit(""))), "search_text": sought, "synonyms": told}
    return _code(good, columns, version, keep or [])


def medicine_codes(rows: DataFrame, version: str, keep: list[str] | None = None) -> DataFrame:
    """Codes of a table of subsidised medicines (S02, F22): rows without both ids or any name are left out."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.when(full("drug_name").isNotNull() & full("li_form").isNotNull(),
        F.concat_ws(" ", "drug_name", "li_form")).otherwise(F.coalesce(full("schedule_form"), full("li_form"), full("drug_name")))
    good = rows.where(filled(F.col("li_item_id")).isNotNull() & filled(F.col("pbs_code")).isNotNull() & filled(name).isNotNull())
    columns = {"code_system": F.lit("pbs"), "code_value": F.trim("li_item_id"), "grouping_code": F.trim("pbs_code"), "display_name": F.trim(name),
        "entity_type": F.lit("medication"), "search_text": F.trim(F.concat_ws(" ", name, full("brand_name")))}
    return _code(good, columns, version, keep or [])


def procedure_codes(rows: DataFrame, version: str, year: int, keep: list[str] | None = None) -> DataFrame:
    """Codes of a schedule of procedures (S04, F23): items that ended before ``year``, and descriptions of less than ten characters, are left
    out; descriptions are squeezed and cut to 500."""
    said = F.left(squeezed(F.col("Description")), F.lit(500))
    full = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    ended = F.get(F.split(F.coalesce("ItemEndDate", F.lit("")), r"\."), 2).try_cast("int") < year
    good = rows.where(full("ItemNum").isNotNull() & (F.length(F.trim("Description")) >= 10) & ~F.coalesce(ended, F.lit(False)))
    value = F.when(full("SubItemNum").isNotNull(), F.concat_ws("_", "ItemNum", "SubItemNum")).otherwise(F.col("ItemNum"))
    sought = F.trim(F.concat(F.lit("MBS "), "ItemNum", F.lit(" "), F.coalesce("Group", F.lit("")), F.lit(" "), said))
    columns = {"code_system": F.lit("mbs"), "code_value": value, "grouping_code": F.coalesce(full("Group"), full("Category")), "display_name": said,
        "entity_type": F.lit("procedure"), "search_text": sought}
    return _code(good, columns, version, keep or [])


def code_errors(system: str) -> dict[str, Column]:
    """What makes a code invalid, by name (F20); for ``split_valid``."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors = {
        "missing": empty("code_system") | empty("code_value") | empty("display_name"), "entity_type": ~F.col("entity_type").isin(*ENTITY_TYPES),
            "search_text": empty("search_text"),
        "library_version": ~F.coalesce(F.col("library_version").rlike(r"^v\d{4}Q[1-4]$"), F.lit(False)),
            "country_code": ~F.coalesce(F.col("country_code").rlike("^[A-Z]{3}$"), F.lit(True)),
    }
    return errors | ({"code_value": ~F.coalesce(F.col("code_value").rlike(r"^\d+-\d+$"), F.lit(False))} if system == "loinc" else {})


def list_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(entity_type, codes) of the codes kept, and a row 'invalid' for the others."""
    return good.groupBy("entity_type").agg(F.count("*").alias("codes")).unionByName(bad.agg(F.count("*").alias("codes")).select(F.lit("invalid").alias("entity_type"), "codes"))
