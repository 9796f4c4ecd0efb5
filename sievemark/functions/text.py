"""Column expressions for messy text: placeholders, lists in strings, numbers in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value", whatever their case.
NULL_LIKE = ("", "null", "none", "na", "n/a", "nan", "-", "--", "[]", "{}", "unknown", '""', "''")
#: What a CSV reader with default settings takes as missing.
READER_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: The characters that ``(?U)\\s`` matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` takes spaces only unless it is told more). No
    regular expression, which would stop at all white space within."""
    return F.trim(c, F.lit(WHITE_SPACE))


def cleaned(c: Column) -> Column:
    """The stripped text, or null for a placeholder. Zero is a value."""
    text = stripped(c.cast("string"))
    # placeholders have seven characters at most, of four bytes each at most before they are in lower case
    return F.when((F.octet_length(text) > 4 * max(map(len, NULL_LIKE))) | ~F.lower(text).isin(*NULL_LIKE), text)


def reader_null(c: Column) -> Column:
    """Null for what a CSV reader would have read as missing, the text itself otherwise."""
    return F.when(~c.isin(*READER_NULLS), c)


def list_items(c: Column) -> Column:
    """A JSON list in a string as an array of cleaned items; a scalar or malformed text is one item,
    nothing an empty array."""
    text = cleaned(c)
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, "$", "array<string>")
    scalar = F.try_variant_get(parsed, "$", "string")
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    found = F.when(text.isNull(), F.array().cast("array<string>")).when(parsed.isNull(), F.array(text)).when(is_list, items).otherwise(F.array(scalar))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), cleaned), lambda x: x.isNotNull())


def whole_number(c: Column) -> Column:
    """The first whole number in a text, thousands separators removed."""
    digits = F.regexp_extract(F.regexp_replace(cleaned(c), ",", ""), r"-?\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def decimal_number(c: Column) -> Column:
    """The first decimal number in a text; a lone asterisk is none, brackets don't matter. An exponent
    counts behind a fraction, as Spark itself writes small and large doubles as text (``8.0E-4``)."""
    text = cleaned(c)
    digits = F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+(?:[eE][+-]?\d+(?!\w))?)?", 0)
    return F.when(text != "*", F.nullif(digits, F.lit("")).try_cast("double"))


def title_case(c: Column) -> Column:
    """A capital after anything but a letter: ``24-parganas`` becomes ``24-Parganas``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def populated(columns: list[str]) -> Column:
    """How many of the columns are not null."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    """One regular expression for any of the patterns, whatever the case."""
    return "(?iU)(?:" + "|".join(patterns) + ")"


def one(pattern: str) -> str:
    return f"(?iU)(?:{pattern})"


def humanized(c: Column) -> Column:
    """``some_flag_name`` as ``Some flag name``."""
    text = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
