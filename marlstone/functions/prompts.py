"""Prompt templates. Axis definitions are parameters with short defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPTION = "Describe what this picture shows in one or two sentences."
DEFINITIONS = {
    "nature": "Nature is what people did not make: living things, land, water, sky and weather.",
    "biotic": "Biotic nature lives or lived; abiotic nature never did.",
    "material": "Material things can be touched; immaterial ones can't.",
}
#: Axes that each kind of system prompt explains, in order.
SYSTEMS = {"caption": ("nature",), "full": ("nature", "biotic", "material"), "material": ("material",)}


def system(kind: str, definitions: dict[str, str] | None = None) -> str:
    """The system prompt of a kind; several definitions are numbered."""
    if kind not in SYSTEMS:
        raise ValueError(f"unknown kind {kind!r}")
    words = DEFINITIONS | (definitions or {})
    parts = [words[a] for a in SYSTEMS[kind]]
    return parts[0] if len(parts) == 1 else "\n\n".join(f"{i}. {p}" for i, p in enumerate(parts, 1))


def extraction(caption: Column) -> Column:
    return F.concat(F.lit("List the things that this caption of the picture names, as JSON with a list `objects`. Caption: "), caption)


def full_label(phrase: Column) -> Column:
    return F.concat(F.lit("Judge by the definitions, as JSON, whether this object in the picture is nature, biotic and material. Object: "), phrase)


def material_label(phrase: Column, biotic: Column) -> Column:
    known = F.when(biotic, F.lit("It is known to be biotic nature.")).when(~biotic, F.lit("It is known to be abiotic nature.")).otherwise(F.lit("It is known to be nature."))
    return F.concat(known, F.lit(" Judge, as JSON, whether this object in the picture is material. Object: "), phrase)


def axis_question(axis: str, name: Column) -> Column:
    """One axis of a class by name; raises for an unknown axis."""
    if axis not in DEFINITIONS:
        raise ValueError(f"unknown axis {axis!r}")
    return F.concat(F.lit(f"{DEFINITIONS[axis]} Which holds for this class? Class: "), name)
