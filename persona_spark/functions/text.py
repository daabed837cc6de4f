"""Column helpers for text: blanks, stripping, names."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from persona_spark.functions import values as V

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def has_text(c: Column) -> Column:
    """True unless the text is missing, empty or only white space."""
    return F.coalesce(c.rlike(_NOT_SPACE), F.lit(False))


def truthy_text(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """The first text that is neither missing nor empty. White space counts as text."""
    return F.coalesce(*[truthy_text(c) for c in cols])


def iso_text(df: DataFrame, column: str) -> Column:
    """A column of ISO times as text: dates and timestamps as the clock of the session shows them, texts as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.col(column)


def sanitize_name(c: Column) -> Column:
    """A text made safe as a file name."""
    kept = F.regexp_replace(c, V.RESERVED_FILE_CHARACTERS, "")
    return F.substring(
        F.regexp_replace(F.replace(kept, F.lit(" "), F.lit("_")), "_{2,}", "_"), 1, V.FILE_NAME_MAX_CHARS
    )


def words(c: Column) -> Column:
    """White-space separated words; no words for a blank text."""
    parts = F.split(strip(c), _SPACES)
    return F.when(has_text(c), parts).otherwise(F.array().cast("array<string>"))


def hash_number(*parts: Column) -> Column:
    """Repeatable number of 32 bits: the first eight hex digits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
