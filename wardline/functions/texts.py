"""Text pieces of a sample and helpers on plain texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.times import age_years, time_text

BLANKS = " \t\n\r\x0b\x0c"

# Encounter column to printed field name, in print order.
ENCOUNTER_FIELDS = (
    ("start", "Beginn"),
    ("type_display", "Kontakt Art"),
    ("v3_act_code", "Art"),
    ("fachabteilungsschluessel", "Fachabteilungsschlüssel"),
    ("aufnahmeanlass_display", "Aufnahmeanlass"),
)


def number_text(value: Column) -> Column:
    """Shortest decimal text: a digit after the point, or an exponent of two digits below 1e-4 and from 1e16."""
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(value)
    everyday = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    power = F.regexp_replace(value.cast("string"), r"\.0E", "E")
    for pattern, text in ((r"E-(\d)$", "e-0$1"), (r"E-(\d\d+)$", "e-$1"), (r"E(\d+)$", "e+$1")):
        power = F.regexp_replace(power, pattern, text)
    return F.when(everyday, value.cast("string")).when((size >= 1e16) | (size < 1e-4), power).otherwise(plain)


def kv_text(pairs: list[tuple[str, Column]]) -> Column:
    """``key<TAB>value`` lines; pairs with a null value are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}\t"), v.cast("string")) for k, v in pairs])


def patient_text(birth: Column, sex: Column, insurance: Column, at: Column) -> Column:
    return kv_text([("age", age_years(birth, at)), ("gender", sex), ("insurance_type", insurance)])


def encounter_text(columns: dict[str, Column]) -> Column:
    """Printed encounter fields; absent columns and null values are left out."""
    pairs = []
    for name, title in ENCOUNTER_FIELDS:
        if name in columns:
            pairs.append((title, time_text(columns[name]) if name == "start" else columns[name]))
    return kv_text(pairs)


def strip_end(text: Column) -> Column:
    """The text without blanks at its end; trimming looks at every character, so it is left to texts that end in a blank."""

    def stripped(whole: Column) -> Column:
        blank = reduce(or_, [whole.endswith(c) for c in BLANKS])
        return F.when(blank, F.rtrim(whole, F.lit(BLANKS))).otherwise(whole)

    return let(text, stripped)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Pieces between single non-word characters, empty pieces included."""
    return F.split(text, "[^A-Za-z_0-9]", -1)


def word_ngrams(text: Column, n: int = 13, min_tokens: int = 3) -> Column:
    """Distinct n-grams of the word pieces, none for texts that are too short."""
    def grams(tokens: Column) -> Column:
        found = F.transform(
            F.sequence(F.lit(1), F.size(tokens) - n + 1),
            lambda i: F.array_join(F.slice(tokens, i, n), " "),
        )
        enough = F.size(tokens) >= max(n, min_tokens)
        return F.when(enough, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return let(word_tokens(text), grams)


def metadata_field(text: Column, name: str) -> Column:
    """Value of the first ``name<TAB>value`` line of a sample text."""
    value = F.regexp_extract(text, rf"(?m)^{name}\t([^\n]*)", 1)
    return F.when(F.length(value) > 0, F.trim(value))
