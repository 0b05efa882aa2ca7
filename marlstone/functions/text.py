"""String, JSON and formatting expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a taxonomy node's name looks like inside a cell.
SYNSET_PATTERN = r"(?U)([\w\-']+\.[nvasr]\.[0-9]+)"


def strip(c: Column) -> Column:
    """Trim all Unicode white space; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_object(c: Column) -> Column:
    """Lower-cased, trimmed phrase without one leading English article."""
    return strip(F.regexp_replace(strip(F.lower(c)), r"^(a|an|the) ", ""))


def normalize_objects(phrases: Column) -> Column:
    """Trimmed phrases without blanks; of phrases that differ in case alone the
    first stays, in order."""
    clean = F.filter(F.transform(phrases, strip), lambda x: x.isNotNull() & (x != ""))
    keys = F.transform(clean, F.lower)
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(clean, F.array_position(keys, k).cast("int")))


def head_noun(c: Column) -> Column:
    """Last word of a phrase of several words, else null."""
    words = F.split(strip(c), r"(?U)\s+")
    return F.when(F.size(words) > 1, F.element_at(words, -1))


def synset_in(cell: Column) -> Column:
    """The first node name in a cell, null if none."""
    return F.nullif(F.regexp_extract(cell, SYNSET_PATTERN, 1), F.lit(""))


def scene_line(line: Column) -> Column:
    """``/a/name 12`` as struct(scene_id, name); null fields if malformed."""
    pattern = r"^(?:/./)?(.*) (\d+)$"
    name = F.nullif(F.regexp_extract(strip(line), pattern, 1), F.lit(""))
    return F.struct(F.regexp_extract(strip(line), pattern, 2).try_cast("int").alias("scene_id"), name.alias("name"))


def list_literal(c: Column) -> Column:
    """A Python list literal of strings as array; null if it is none."""
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})


def response_status(raw: Column) -> Column:
    """object, not_object (valid JSON of another kind) or malformed."""
    value = F.try_parse_json(raw)
    return (
        F.when(value.isNull(), F.lit("malformed"))
        .when(F.schema_of_variant(value).startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("not_object"))
    )


def parse_response(raw: Column, schema: str) -> Column:
    """A response's fields, null as a whole unless it is a JSON object."""
    return F.when(response_status(raw) == "object", F.from_json(raw, schema))


def duration(seconds: Column) -> Column:
    """``D-HH:MM:SS``, half a second to the even one; null for null."""
    s = F.bround(seconds.cast("double"), 0).cast("long")
    return F.when(
        seconds.isNotNull(),
        F.format_string("%d-%02d:%02d:%02d", F.floor(s / 86400).cast("long"), F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60),
    )


def time_left(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the mean rate so far; null before the first is done."""
    return F.try_divide(elapsed, done) * F.greatest(total - done, F.lit(0))


def join_reasons(*parts: Column) -> Column:
    """Non-empty parts joined by a space, null if none."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def scene_display(name: Column) -> Column:
    return F.translate(name, "/_", "  ")


def node_display(node: Column, whole: bool = False) -> Column:
    """A node's name for people: the text before its first dot, or with
    ``whole`` all but the last two dotted parts."""
    name = F.regexp_replace(node, r"\.[^.]*\.[^.]*$", "") if whole else F.substring_index(node, ".", 1)
    return F.translate(name, "_", " ")


def model_slug(c: Column) -> Column:
    return F.translate(c, "/", "_")


def config_key(max_samples: Column) -> Column:
    return F.coalesce(max_samples.cast("string"), F.lit("full"))


def photo_of(c: Column) -> Column:
    return F.format_string("a photo of a %s", c)


def data_url(path: Column, content: Column) -> Column:
    """A data URL of image bytes; the type is the suffix, png if there is none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "", "png").when(suffix == "jpg", "jpeg").otherwise(suffix)
    return F.when(path.startswith("data:"), path).otherwise(F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content)))
