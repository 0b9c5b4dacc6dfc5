"""Text expressions: normalisers, identifiers and check digits, all as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that the general normaliser deletes, and strict seal text deletes.
GENERAL_SEPARATORS = r"(?U)[\s:：,，.。()（）\[\]【】\-_/]"
SEAL_SEPARATORS = r"(?U)[\s()（）|｜]"
NAME_SEPARATORS = r"[、,，/／;；|｜]"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def normalize(text: Column) -> Column:
    """Delete white space and common separators, then lower-case; null becomes empty (STR-01)."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), GENERAL_SEPARATORS, ""))


def fold_width(text: Column) -> Column:
    """Full-width ASCII (FF01 to FF5E) to ASCII, and nothing else."""
    return F.translate(text, _FULL, _HALF)


def seal_key(text: Column) -> Column:
    """Strict form of a requirement: width folded, white space, brackets and bars deleted (STR-02, STR-19)."""
    return F.regexp_replace(fold_width(F.coalesce(text, F.lit(""))), SEAL_SEPARATORS, "")


def bracketed(text: Column) -> Column:
    """The token in brackets if there is exactly one pair, else empty (STR-05)."""
    found = F.regexp_extract_all(text, F.lit(r"[(（]([^()（）]*)[)）]"), 1)
    return F.when(F.size(found) == 1, found[0]).otherwise("")


def after_colon(text: Column) -> Column:
    """What follows the first colon of either width, trimmed; empty without one (STR-07)."""
    return F.trim(F.regexp_extract(text, r"(?s)^[^:：]*[:：](.*)$", 1))


def names(text: Column) -> Column:
    """Distinct non-empty names, in order (STR-09)."""
    return F.array_distinct(F.filter(F.transform(F.split(text, NAME_SEPARATORS), F.trim), lambda n: n != ""))


def ean13_valid(code: Column) -> Column:
    """Thirteen digits whose last is the check digit of the others (STR-13)."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(code, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    return F.when(code.rlike(r"^[0-9]{13}$"), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.substring(code, 13, 1).cast("int")).otherwise(False)


def page_identity(name: Column) -> tuple[Column, Column]:
    """Receipt key and page number: ``key_NN.ext`` has a number, other names are page 0 of their stem (STR-15)."""
    paged = name.rlike(r"^(.+?)_([0-9]{2})(\.[^.]+)$")
    key = F.when(paged, F.regexp_extract(name, r"^(.+?)_([0-9]{2})(\.[^.]+)$", 1)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return key, F.when(paged, F.regexp_extract(name, r"^(.+?)_([0-9]{2})(\.[^.]+)$", 2).cast("int")).otherwise(0)


def trailing_serial(text: Column) -> Column:
    """The run of 13 to 15 digits that ends the text, unless letters or digits precede it; else empty (STR-21)."""
    return F.regexp_extract(text, r"(?:^|[^0-9A-Za-z])([0-9]{13,15})$", 1)


def safe_name(text: Column, most: int = 80) -> Column:
    """Characters that file systems reject become underscores, bounded in length (STR-17)."""
    return F.substring(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1F]', "_"), 1, most)


def clean_cell(text: Column) -> Column:
    """Without the control characters that spreadsheets reject (STR-23)."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def strip_label(value: Column, label: str) -> Column:
    """The text without a leading label and colon, and without blanks, underscores and colons at its ends (STR-06)."""
    return F.btrim(F.regexp_replace(value, rf"^\s*\Q{label}\E\s*[:：]?", ""), F.lit(" _：:"))


def sample_number(name: Column) -> tuple[Column, Column]:
    """The ten digits of the order in a file's name, and the name of its page: digits, page suffix, extension (STR-16)."""
    pattern = r"(?<![0-9])([0-9]{10})(?![0-9])"
    digits = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return digits, F.concat(digits, F.regexp_extract(name, r"((?:_[0-9]{2})?\.[^.]+)$", 1))


def differing_places(a: Column, b: Column) -> Column:
    """Places, from zero, at which two texts have different characters, to the end of the longer (ARR-03)."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    return F.filter(F.transform(same, lambda ok, i: F.when(~ok, i)), lambda i: i.isNotNull())


def same_decimal(a: Column, b: Column) -> Column:
    """Whether two texts are the same number, blanks aside; false where one isn't a number (MAT-11)."""
    number = lambda c: F.regexp_replace(c, r"(?U)\s", "").try_cast("double")
    return F.coalesce(number(a) == number(b), F.lit(False))
