"""References, codings, extensions and code lookups (FHIR columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Insurance identifier to label.
INSURANCE = {"PKV": "privat", "GKV": "gesetzlich"}
INSURANCE_OTHER = "unbekannt"

# Imaging modalities that stay labels of their own.
MODALITIES = ("CR", "CT", "MR", "US", "XA", "NM", "OT")

# Code prefixes that are never a label.
EXCLUDED_PREFIXES = ("GB", "GROUPBOX", "PATSTURZ")

# Tumour documentation form to tumour group.
TUMOR_TYPES = {
    "DCP01BASIS": "Magen-Darm Tumoren",
    "DCP01BASIS2": "Magen-Darm Tumoren",
    "DCP01BASIS3": "Magen-Darm Tumoren",
    "RLKTUMORBAS": "Lungen- und Thoraxtumoren",
    "RLKTUMORBAS2": "Lungen- und Thoraxtumoren",
    "RLKTUMORBAS3": "Lungen- und Thoraxtumoren",
    "DCP03BASIS": "Leukämien, Lymphome und Myelome",
    "DCP03BASIS2": "Leukämien, Lymphome und Myelome",
    "DCP03BASIS3": "Leukämien, Lymphome und Myelome",
    "DCP04BASIS": "Gynäkologische Tumoren",
    "DCP04BASIS2": "Gynäkologische Tumoren",
    "DCP04BASIS2B": "Gynäkologische Tumoren",
    "DCP04BASISB": "Gynäkologische Tumoren",
    "DCP05BASIS": "Neuroonkologische Tumoren",
    "DCP05BASIS2": "Neuroonkologische Tumoren",
    "DCP06BASIS": "Tumoren der Harn- und Geschlechtsorgane",
    "DCP06BASIS2": "Tumoren der Harn- und Geschlechtsorgane",
    "DCP06BASIS3": "Tumoren der Harn- und Geschlechtsorgane",
    "DCP07BASIS": "Pädiatrische Hämatologie/Onkologie",
    "DCP07BASIS2": "Pädiatrische Hämatologie/Onkologie",
    "DCP08BASIS": "Hauttumoren",
    "DCP08BASIS2": "Hauttumoren",
    "DCP08BASIS3": "Hauttumoren",
    "DCP09BASIS": "Endokrine Tumoren",
    "DCP09BASIS2": "Endokrine Tumoren",
    "DCP10BASIS": "Kopf-Hals-Tumoren",
    "DCP10BASIS2": "Kopf-Hals-Tumoren",
    "DCP10BASIS3": "Kopf-Hals-Tumoren",
    "DCP10BASIS4": "Kopf-Hals-Tumoren",
    "DCP11BASIS": "Augentumoren",
    "DCP11BASIS2": "Augentumoren",
    "DCP12BASIS": "Knochen- und Weichteiltumoren (Sarkome)",
    "DCP12BASIS2": "Knochen- und Weichteiltumoren (Sarkome)",
    "DCP14BASIS": "Lebertumoren",
    "DCP14BASIS2": "Lebertumoren",
}


def lookup(col: Column, table: dict[str, str]) -> Column:
    """Value of a literal map, null where the key is missing."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def strip_ref(ref: Column, resource: str) -> Column:
    """Reference without its ``Resource/`` part."""
    return F.replace(ref, F.lit(f"{resource}/"), F.lit(""))


def extract_id(ref: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(ref, "/", -1)


def first_coding(concept: Column, name: str) -> Column:
    return F.get(concept["coding"], F.lit(0))[name]


def extension_value(extensions: Column, url: str, name: str = "valueString") -> Column:
    """Value of the first extension with this url."""
    return F.get(F.filter(extensions, lambda e: e["url"] == F.lit(url)), F.lit(0))[name]


def code_in_system(codings: Column, system: str) -> Column:
    """struct(code, display) of the first coding of a code system."""
    hit = F.get(F.filter(codings, lambda c: c["system"] == F.lit(system)), F.lit(0))
    return F.struct(hit["code"].alias("code"), hit["display"].alias("display"))


def safe_get(objects: Column, name: str) -> Column:
    """Values of one attribute over a list of objects; null stays null."""
    return F.transform(objects, lambda o: o[name])


def scalar_or_null(values: Column) -> Column:
    """The only value of a one-element list, null otherwise."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def reduce_cardinality(values: Column, take_first: bool = False, set_to_none: bool = False) -> Column:
    """Empty list to null, one value (or ``take_first``) to the smallest value.

    Longer lists become null with ``set_to_none``; otherwise they are kept, so
    the result is a list in that mode and a scalar in the other two.
    """
    smallest = F.array_min(values)
    if take_first:
        return F.when(F.size(values) > 0, smallest)
    if set_to_none:
        return F.when(F.size(values) == 1, smallest)
    return F.when(F.size(values) > 0, values)


def first_positional(values: Column) -> Column:
    return F.get(values, F.lit(0))


def category_name(categories: Column) -> Column:
    """First entry without a blank, else the first with blanks as ``_``."""
    plain = F.get(F.filter(categories, lambda c: ~F.contains(c, F.lit(" "))), F.lit(0))
    joined = F.replace(F.get(categories, F.lit(0)), F.lit(" "), F.lit("_"))
    return F.coalesce(plain, joined, F.lit("unknown"))


def map_insurance(code: Column) -> Column:
    return F.coalesce(lookup(code, INSURANCE), F.lit(INSURANCE_OTHER))


def map_tumor_type(form: Column) -> Column:
    return lookup(form, TUMOR_TYPES)


def icd_chapter(code: Column) -> Column:
    """Part of a code before its first dot."""
    return F.substring_index(code, ".", 1)


def fold_vocabulary(label: Column, allowed: tuple[str, ...] = MODALITIES, other: str = "OT") -> Column:
    return F.when(label.isin(*allowed), label).otherwise(F.lit(other))


def is_label_code(code: Column, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES) -> Column:
    """True unless the code is null or starts with an excluded prefix."""
    keep = code.isNotNull()
    for prefix in prefixes:
        keep = keep & ~code.startswith(prefix)
    return keep


def sha256_id(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)
