"""Column expressions over text: commit messages, identities, dirty values, repository URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import PLACEHOLDERS

# The bug-fix vocabulary.
BUG_FIX_WORDS = (
    "fix|fixed|fixes|bugs?|bugfix(?:es)?|defects?|crash(?:es|ed)?|incorrect(?:ly)?|"
    "exceptions?|npes?|regressions?"
)
# The inspection vocabulary used to judge how specific an action text is.
INSPECTION_VERBS = "inspect|review|check|audit|trace|verify|examine|test|compare|confirm"
INSPECTION_TARGETS = (
    "edits?|changes?|diffs?|rewrites?|rework|fixes|regressions?|tests?|coverage|ownership|"
    "owners?|maintainers?|handoffs?|commits?|churn|hotspots?|dependencies|interfaces?|"
    "callers?|boundaries|failures?|history|coupling"
)
GENERIC_PHRASES = (
    "review (?:the )?(?:code|detailed (?:prediction|explanation))|"
    "improve (?:code )?quality|follow best practices|be careful"
)
# Repository identity patterns.
OWNER_PATTERN = "^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$"
NAME_PATTERN = "^[A-Za-z0-9._-]+$"
# A decimal number; casts alone would also take type suffixes and hexadecimal digits.
NUMBER_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def strip(text: Column) -> Column:
    """Remove ASCII white space, not only blanks, from both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def has_words(text: Column, words: str) -> Column:
    """Whole-word, case-insensitive search with Unicode case folding; null counts as no match."""
    return F.coalesce(text.rlike(rf"(?iuU)\b(?:{words})\b"), F.lit(False))


def is_bug_fix(message: Column) -> Column:
    return has_words(message, BUG_FIX_WORDS)


def is_java_path(path: Column) -> Column:
    return path.endswith(".java")


def developer_identity(email: Column, name: Column) -> Column:
    address = F.lower(strip(F.coalesce(email, F.lit(""))))
    return F.when(address != "", address).otherwise(
        F.concat(F.lit("name:"), F.lower(strip(name))))


def utc_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text; texts without an offset are read as UTC, bad texts are null."""
    return trimmed_timestamp(strip(text))


def trimmed_timestamp(trimmed: Column) -> Column:
    """``utc_timestamp`` of a text without white space at its ends."""
    # Calendar days, the common case, are read as days and need no zone.
    return F.when(
        trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.timestamp_micros(F.unix_date(trimmed.try_cast("date")).cast("long") * 86_400_000_000),
    ).when(trimmed.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), trimmed.try_cast("timestamp")).otherwise(
        F.concat(trimmed, F.lit("Z")).try_cast("timestamp"))


def utc_day(column: Column, data_type: T.DataType) -> Column:
    """UTC calendar day of a date, timestamp or ISO text, whatever the session time zone."""
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.TimestampNTZType):
        return F.to_date(column)
    if isinstance(data_type, T.StringType):
        column = utc_timestamp(column)
    elif not isinstance(data_type, T.TimestampType):
        raise ValueError(f"A day cannot be read from {data_type.simpleString()}.")
    return F.date_from_unix_date(F.floor(F.unix_micros(column) / 86_400_000_000).cast("int"))


def clean_text(column: Column) -> Column:
    """Trimmed text, or null for blanks and placeholder words."""
    text = strip(column.cast("string"))
    return F.when(~F.lower(text).isin(PLACEHOLDERS), text)


def with_clean_texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``clean_text`` of the named columns, for tables of many rows.

    Most values need no cleaning: only those with white space, or another character up to it, at an end are trimmed, and only those
    no longer than a placeholder are compared with them. Each step refers to columns, so no value is taken twice.
    """
    def trimmed(c: Column) -> Column:
        return F.when((c < "!") | (F.substring(c, -1, 1) < "!"), strip(c)).otherwise(c)

    longest = max(map(len, PLACEHOLDERS))
    return df.withColumns({n: F.col(n).cast("string") for n in names}).withColumns(
        {n: trimmed(F.col(n)) for n in names}).withColumns({n: F.when(
            (F.length(n) > longest) | ~F.lower(n).isin(PLACEHOLDERS), F.col(n)) for n in names})


def clean_number(column: Column, data_type: T.DataType) -> Column:
    """Finite double, or null; booleans are not numbers, numeric texts are."""
    if isinstance(data_type, T.BooleanType):
        return F.lit(None).cast("double")
    return any_number(column, data_type)


def any_number(column: Column, data_type: T.DataType) -> Column:
    """Finite double of a number or of its text, or null. Doubles and whole numbers are not written out and read again."""
    if isinstance(data_type, (T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = column.cast("double")
        return F.when(is_finite(number), number)
    return read_number(column.cast("string"))


def read_number(text: Column) -> Column:
    """Finite double of a decimal text, white space around it allowed; anything else is null."""
    trimmed = strip(text)
    number = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
    return F.when(is_finite(number), number)


def is_finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def clean_day(column: Column) -> Column:
    """UTC timestamp of a cleaned text or null."""
    return utc_timestamp(clean_text(column))


def blank(column: Column) -> Column:
    """Trimmed text with null read as the empty string."""
    return F.coalesce(strip(column.cast("string")), F.lit(""))


def repository_identity(url: Column) -> Column:
    """struct(owner, name, slug) of a public https repository address, or null.

    Accepts exactly owner and name under github.com or www.github.com, without user, port,
    query, fragment or path parameters; a ``.git`` suffix of the name is removed.
    """
    text = strip(url)
    shape = r"^(?i:https)://(?i:(?:www\.)?github\.com)/+([^/?#;]+)/+([^/?#;]+)/*;?\??#?$"
    owner = F.regexp_extract(text, shape, 1)
    name = F.regexp_replace(F.regexp_extract(text, shape, 2), r"\.git$", "")
    valid = owner.rlike(OWNER_PATTERN) & name.rlike(NAME_PATTERN) & ~name.isin(".", "..")
    return F.when(valid, F.struct(
        owner.alias("owner"), name.alias("name"), F.concat_ws("/", owner, name).alias("slug")))


def sample_id(project: Column, path: Column, day: Column) -> Column:
    return F.concat_ws("|", project, path, day)
