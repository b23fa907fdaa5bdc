"""Text functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """Without blanks at both ends, Unicode blanks included."""
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def pad_start(value: Column, width, pad: str = " ") -> Column:
    """Left-pad; text that is already longer stays whole."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, F.lit(pad)))


def pad_end(value: Column, width, pad: str = " ") -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.length(value) >= width, value).otherwise(F.rpad(value, width, F.lit(pad)))


def mask(value: Column, shown: int = 4) -> Column:
    """All but the last characters as asterisks."""
    return pad_start(F.right(value, F.lit(shown)), F.length(value), "*")


def zero_fill(number: Column, width: int) -> Column:
    """The last ``width`` characters of the number behind zeros."""
    return F.right(F.concat(F.lit("0" * (width - 1)), number.cast("string")), F.lit(width))


def middle_field(value: Column, sep: str = "|") -> Column:
    """What stands between the first and the last separator."""
    first, last = F.instr(value, sep), F.instr(F.reverse(value), sep)
    return F.substring(value, first + 1, F.length(value) - first - last)


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace markers one after the other. A missing value makes the text null."""
    for marker, value in values.items():
        template = F.replace(template, F.lit(marker), value)
    return template


def template_names(template: Column) -> Column:
    """The names in ``{{name}}`` markers, in order."""
    return F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))


def queue_head(queue: Column, sep: str = "|") -> Column:
    """First entry of a queue text; null when it has no separator."""
    return F.when(F.instr(queue, sep) > 0, F.substring_index(queue, sep, 1))


def queue_rest(queue: Column, sep: str = "|") -> Column:
    at = F.instr(queue, sep)
    return F.when(at > 0, F.substring(queue, at + 1, F.length(queue))).otherwise(queue)


def escape_html(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def endpoint(url: Column) -> Column:
    """The URL up to its query; NA where there is no URL."""
    return F.coalesce(F.substring_index(url, "?", 1), F.lit("NA"))


def query_map(url: Column) -> Column:
    """The query parameters of a URL; of a name given twice the last value wins."""
    text = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.str_to_map(F.when(text != "", text), F.lit("&"), F.lit("="))
    return F.transform_values(pairs, lambda _, v: F.coalesce(F.try_url_decode(v), v, F.lit("")))


def size_text(n: Column) -> Column:
    """1536 as ``1.5 KB``; stops at GB."""
    def step(power: int, unit: str) -> Column:
        return F.format_string("%.1f " + unit, n.cast("double") / float(1024 ** power))
    return (F.when(n < 1024, step(0, "B")).when(n < 1024 ** 2, step(1, "KB"))
            .when(n < 1024 ** 3, step(2, "MB")).otherwise(step(3, "GB")))


def repaired(data: Column) -> Column:
    """Bytes as text, with each broken sequence replaced."""
    return F.make_valid_utf8(data.cast("string"))
