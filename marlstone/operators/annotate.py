"""Model inference as partition-batched stages behind one interface."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import prompts
from marlstone.functions.text import join_reasons, normalize_objects, parse_response
from marlstone.schemas import EXTRACTION, FULL_LABEL, MATERIAL_LABEL
from marlstone.session import ship


class TooLong(Exception):
    """A batch that the model can't take as a whole."""


class Annotator(Protocol):
    def annotate(self, prompts: list[str], images: list[str], system: str | None, schema: str | None) -> list[str | None]:
        """As many responses as prompts; raises TooLong if they don't fit."""


_ANNOTATORS: dict[str, Callable[[], Annotator]] = {}


def register(name: str, make: Callable[[], Annotator]) -> None:
    _ANNOTATORS[name] = make


def create(name: str) -> Annotator:
    if name not in _ANNOTATORS:
        raise ValueError(f"unknown annotator {name!r}; known: {sorted(_ANNOTATORS)}")
    return _ANNOTATORS[name]()


class RuleAnnotator:
    """A deterministic stand-in for a model, for tests and dry runs.

    Words of ``living`` are biotic nature, of ``lifeless`` abiotic nature; a
    prompt longer than ``limit`` characters is too long."""

    def __init__(self, living: tuple[str, ...] = ("dog", "tree", "bird", "ring"), lifeless: tuple[str, ...] = ("river", "rock"), limit: int = 4000):
        self.living, self.lifeless, self.limit = living, lifeless, limit

    def annotate(self, prompts: list[str], images: list[str], system: str | None, schema: str | None) -> list[str | None]:
        if sum(map(len, prompts)) > self.limit * max(1, len(prompts)) or any(len(p) > self.limit for p in prompts):
            raise TooLong
        return [self._one(p, i, schema) for p, i in zip(prompts, images, strict=True)]

    def _one(self, prompt: str, image: str, schema: str | None) -> str:
        subject = prompt.rsplit(": ", 1)[-1].strip()
        if schema == "objects":
            return json.dumps({"objects": [w for w in subject.replace(".", " ").split() if len(w) > 2]})
        if schema == "label":
            living, lifeless = any(w in subject for w in self.living), any(w in subject for w in self.lifeless)
            life = "biotic" if living else "abiotic" if lifeless else "none"
            return json.dumps({"nature_reasoning": "by rule", "nature": "yes" if living or lifeless else "no", "sub_axes_reasoning": "", "life_category": life, "tangibility": "material" if living or lifeless else "none"})
        if schema == "material":
            return json.dumps({"reasoning": "by rule", "tangibility": "immaterial" if "light" in subject else "material"})
        return f"a picture of {image}"


register("rule", RuleAnnotator)


def annotate_safely(model: Annotator, prompts: list[str], images: list[str], system: str | None, schema: str | None) -> list[str | None]:
    """Halve a batch that is too long until it fits; a single one that doesn't
    gives null. Other errors pass; order is kept."""
    if not prompts:
        return []
    try:
        found = model.annotate(prompts, images, system, schema)
    except TooLong:
        if len(prompts) == 1:
            return [None]
        half = len(prompts) // 2
        return annotate_safely(model, prompts[:half], images[:half], system, schema) + annotate_safely(model, prompts[half:], images[half:], system, schema)
    if len(found) != len(prompts):
        raise ValueError(f"{len(found)} responses for {len(prompts)} prompts")
    return found


def respond(rows: DataFrame, name: str, prompt: str, image: str, out: str, system: str | None = None, schema: str | None = None, batch: int = 16, make: Callable[[], Annotator] | None = None) -> DataFrame:
    """Rows with the model's raw response to each prompt; the model is made once
    a task, and takes ``batch`` prompts at a time."""
    build = make or _ANNOTATORS.get(name)
    if build is None:
        create(name)

    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for frame in frames:
            asked, seen = frame[prompt].tolist(), frame[image].tolist()
            found: list[Any] = []
            for i in range(0, len(asked), batch):
                found += annotate_safely(model, asked[i : i + batch], seen[i : i + batch], system, schema)
            frame = frame.copy()
            frame[out] = pd.Series(found, index=frame.index, dtype=object)
            yield frame

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{types}, `{out}` string")


def captions(images: DataFrame, name: str = "rule", image: str = "image_path", **more) -> DataFrame:
    """Images with a caption; a response that is none gives the empty one."""
    asked = images.withColumn("_prompt", F.lit(prompts.CAPTION))
    return respond(asked, name, "_prompt", image, "caption", **more).withColumn("caption", F.coalesce("caption", F.lit(""))).drop("_prompt")


def extracted_objects(captioned: DataFrame, name: str = "rule", image: str = "image_path", **more) -> DataFrame:
    """Captioned images with their normalised objects; none on failure."""
    asked = captioned.withColumn("_prompt", prompts.extraction(F.col("caption")))
    raw = respond(asked, name, "_prompt", image, "_raw", schema="objects", **more)
    objects = normalize_objects(parse_response(F.col("_raw"), EXTRACTION)["objects"])
    return raw.withColumn("objects", F.coalesce(objects, F.array().cast("array<string>"))).drop("_prompt", "_raw")


def labelled_objects(objects: DataFrame, name: str = "rule", image: str = "image_path", **more) -> DataFrame:
    """Objects (image, obj_idx, object, mapped, map_nature, map_biotic) with a raw
    label: unmapped ones get the full question, mapped nature the one about the
    material alone, and mapped ones that aren't nature no question at all.

    Each way is filtered before the model, as no filter passes a Python stage."""
    mapped, nature = F.coalesce(F.col("mapped"), F.lit(False)), F.coalesce(F.col("map_nature"), F.lit(False))
    none = F.lit(None).cast("string")

    def label(rows, reasoning, nat, bio, mat, failed, called):
        return rows.select(*objects.columns, F.struct(reasoning.alias("reasoning"), nat.alias("nature"), bio.alias("biotic"), mat.alias("material"), failed.alias("parse_failed"), called.alias("vlm_called")).alias("label"))

    full = respond(objects.filter(~mapped).withColumn("_prompt", prompts.full_label(F.col("object"))), name, "_prompt", image, "_raw", prompts.system("full"), "label", **more)
    full = full.withColumn("_r", parse_response(F.col("_raw"), FULL_LABEL))
    why = join_reasons(F.col("_r.nature_reasoning"), F.col("_r.sub_axes_reasoning"))
    one = label(full, why, F.col("_r.nature"), F.col("_r.life_category"), F.col("_r.tangibility"), F.col("_r").isNull(), F.lit(True))
    part = objects.filter(mapped & nature).withColumn("_prompt", prompts.material_label(F.col("object"), F.col("map_biotic")))
    part = respond(part, name, "_prompt", image, "_raw", prompts.system("material"), "material", **more).withColumn("_r", parse_response(F.col("_raw"), MATERIAL_LABEL))
    two = label(part, F.nullif("_r.reasoning", F.lit("")), none, none, F.col("_r.tangibility"), F.col("_r").isNull(), F.lit(True))
    three = label(objects.filter(mapped & ~nature), none, none, none, none, F.lit(False), F.lit(False))
    return one.unionByName(two).unionByName(three)


def questions(images: DataFrame, asked: dict[str, str], name: str = "rule", image: str = "image_path", done: DataFrame | None = None, failed: str | None = None, **more) -> DataFrame:
    """Images with a map of question to answer; a fixed, small set of questions.
    Pairs in ``done`` (image, question, answer) keep that answer and aren't asked
    again; ``failed`` is the answer where the model can't take the question."""
    grid = images.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in asked.items()])))
    grid = grid.select(*images.columns, F.col("_q.k").alias("_k"), F.col("_q.v").alias("_prompt"))
    if done is not None:
        known = done.select(F.col(image).alias("_i"), F.col("question").alias("_q"), F.col("answer").alias("_known"), F.lit(True).alias("_done"))
        # Filtered before the model, as no filter passes a Python stage.
        grid = grid.join(known, (F.col(image) == F.col("_i")) & (F.col("_k") == F.col("_q")), "left").drop("_i", "_q")
        kept = grid.filter("_done").withColumn("_a", F.col("_known")).drop("_known", "_done")
        grid = grid.filter("_done IS NULL").drop("_known", "_done")
    said = respond(grid, name, "_prompt", image, "_a", **more)
    if failed is not None:
        said = said.withColumn("_a", F.coalesce("_a", F.lit(failed)))
    if done is not None:
        said = said.unionByName(kept)
    return said.groupBy(*images.columns).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_a")))).alias("answers"))
