"""Column helpers that read one note page."""

from pyspark.sql import Column, functions as F

from persona_spark.functions import values as V
from persona_spark.functions.text import first_truthy, strip, truthy_text
from persona_spark.model import BLOCK_PAYLOAD, TITLE_PROPERTY

# A clock: hours, then perhaps minutes, seconds and a fraction, with colons throughout or not at all.
# Groups: hours, colon or nothing, minutes, seconds, fraction.
_CLOCK = r"([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\%d([0-5]\d)(?:[.,](\d+))?)?)?"

# Calendar date, optionally followed by any one separator, a clock and an offset, or by a Z alone.
_ISO = rf"\A\d{{4}}-\d{{2}}-\d{{2}}(?:Z|[^Z]{_CLOCK % 2}(?:Z|([+-]){_CLOCK % 8})?)?\z"


def _joined_segments(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.coalesce(s["plain_text"], F.lit(""))), "")


def block_text(blocks: Column) -> Column:
    """Text of the top-level blocks, one line each.

    The payload of a block lies under the key its type names. A payload without rich text gives no
    line, one with an empty list gives an empty line. Missing blocks give null.
    """
    rich = F.transform(blocks, lambda b: F.from_json(b[b["type"]], BLOCK_PAYLOAD)["rich_text"])
    lines = F.transform(F.filter(rich, lambda r: r.isNotNull()), _joined_segments)
    return F.array_join(lines, "\n")


def display_title(properties: Column, page_id: Column) -> Column:
    """Title for lists: the first title property, else the one called Name, else the id's tail."""
    parsed = F.transform(F.map_values(properties), lambda v: F.from_json(v, TITLE_PROPERTY))
    first = F.get(F.filter(parsed, lambda p: p["type"] == "title"), F.lit(0))["title"]
    named = F.from_json(properties["Name"], TITLE_PROPERTY)
    return F.coalesce(
        truthy_text(strip(_joined_segments(first))),
        F.when(named["type"] == "title", truthy_text(strip(_joined_segments(named["title"])))),
        F.when(page_id != "", F.concat(F.lit(V.PAGE_LABEL_PREFIX), F.right(page_id, F.lit(V.ID_TAIL)))),
        F.lit(V.UNTITLED_LABEL),
    )


def prompt_title(
    properties: Column, plain_title: Column | None = None, default: str = V.DEFAULT_PROMPT_TITLE
) -> Column:
    """Title for prompts: the first segment of the property keyed `title`, as it stands. The plain
    title counts only where no such property exists."""
    prop = properties["title"]
    parsed = F.from_json(prop, TITLE_PROPERTY)
    segment = F.when(parsed["type"] == "title", F.get(parsed["title"], F.lit(0))["plain_text"])
    plain = F.lit(None).cast("string") if plain_title is None else plain_title
    return F.coalesce(F.when(prop.isNull(), plain).otherwise(segment), F.lit(default))


def created_date(created_time: Column) -> Column:
    """The local calendar day of an ISO time, null when it is not one. Offsets do not move the day."""
    return F.when(
        created_time.rlike(_ISO) & ~created_time.startswith("0000"),
        F.try_to_date(F.substring(created_time, 1, 10)),
    )


def created_instant(created_time: Column) -> Column:
    """The instant of an ISO time, for ordering. Times without an offset count as UTC."""

    def number(group: int) -> Column:
        return F.coalesce(F.regexp_extract(created_time, _ISO, group).try_cast("bigint"), F.lit(0))

    def clock(first: int) -> Column:
        seconds = (number(first) * 60 + number(first + 2)) * 60 + number(first + 3)
        fraction = F.rpad(F.regexp_extract(created_time, _ISO, first + 4), 6, "0").cast("bigint")
        return seconds * 1_000_000 + fraction

    sign = F.when(F.regexp_extract(created_time, _ISO, 6) == "-", -1).otherwise(1)
    days = F.unix_date(created_date(created_time)).cast("bigint")
    return F.timestamp_micros(days * 86_400_000_000 + clock(1) - sign * clock(7))


def display_label(title: Column, created: Column) -> Column:
    return F.when(
        created.isNotNull(), F.concat(title, F.lit(" ("), F.date_format(created, V.SHORT_DATE), F.lit(")"))
    ).otherwise(title)


def memory_text(content: Column, alt_content: Column) -> Column:
    return first_truthy(content, alt_content)
