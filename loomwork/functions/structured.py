"""JSON text, XML notes and delimited arrays in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import escape_html

_STRING = r'"(?:[^"\\]|\\.)*"'


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def describe_json(text: Column) -> Column:
    """``null``, ``bool(True)``, ``int(1)``, ``float(1.5)``, ``str('a')``, ``array[2]``, ``object{1 keys}``."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    raw = F.trim(text)
    return (F.when(value.isNull(), "not json").when(kind == "VOID", "null")
            .when(kind == "BOOLEAN", F.concat(F.lit("bool("), F.initcap(raw), F.lit(")")))
            .when(kind == "BIGINT", F.concat(F.lit("int("), raw, F.lit(")")))
            .when(kind == "STRING", F.concat(F.lit("str('"), F.try_variant_get(value, "$", "string"), F.lit("')")))
            .when(kind.startswith("ARRAY"), F.concat(F.lit("array["), F.json_array_length(text).cast("string"), F.lit("]")))
            .when(kind.startswith("OBJECT"), F.concat(F.lit("object{"), F.size(F.json_object_keys(text)).cast("string"), F.lit(" keys}")))
            .otherwise(F.concat(F.lit("float("), raw, F.lit(")"))))


def json_nodes(text: Column) -> Column:
    """Number of values in a JSON text at any depth: objects, arrays and scalars; keys do not count. Null for other text."""
    bare = F.regexp_replace(F.regexp_replace(text, _STRING, "s"), r"s\s*:", "")
    count = F.size(F.regexp_extract_all(bare, F.lit(r"[\[{]|s|-?\d[\d.eE+-]*|true|false|null"), F.lit(0)))
    return F.when(F.try_parse_json(text).isNotNull(), count)


def json_leaves(text: Column) -> Column:
    """The scalars of nested JSON arrays of any depth, in order, as text."""
    return F.regexp_extract_all(text, F.lit(_STRING + r"|-?\d[\d.eE+-]*|true|false|null"), F.lit(0))


def note(code: Column, kind: Column, text: Column) -> Column:
    """One XML note; its text is escaped."""
    return F.concat(F.lit("<Note><NoteId>"), code, F.lit("</NoteId><NoteType>"), kind, F.lit("</NoteType><NoteText>"),
                    escape_html(text), F.lit("</NoteText></Note>"))


def without_note(xml: Column, code: str) -> Column:
    """Take every note with this code out of a list of notes."""
    return F.regexp_replace(xml, rf"(?s)<Note>(?:(?!</Note>).)*?<NoteId>\s*{code}\s*</NoteId>.*?</Note>", "")


def pipe_rows(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """A pipe-separated text as rows ``(id, data)``; ids from 1."""
    cut = df.select(*keep, F.posexplode(F.split(value, r"\|")).alias("id", "data"))
    return cut.withColumn("id", F.col("id") + 1)
