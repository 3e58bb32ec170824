"""Typed scene predicates, read from rows and compiled to columns.

A row has definition_id, predicate_id, type, params (a JSON object), weight and enabled. All predicates become one projection
over scenes, and the object counts that they ask for one conditional aggregation, so scenes are read once whatever the number of
predicates.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters of each type; fixed values.
TYPES = {
    "tag": ("tags",), "category": ("categories",), "sensor_channel": ("required_channels",), "time_range": ("start_timestamp_us", "end_timestamp_us"),
    "object_count": ("category", "min_count", "max_count"), "ego_speed": ("min_speed_mps", "max_speed_mps"), "custom": ("expression",),
}


@dataclass(frozen=True)
class Predicate:
    definition_id: str
    predicate_id: str
    type: str
    params: Mapping[str, object] = field(default_factory=dict)
    weight: float = 1.0
    enabled: bool = True

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"{self.predicate_id}: unknown type {self.type}")
        if unknown := sorted(set(self.params) - set(TYPES[self.type])):
            raise ValueError(f"{self.predicate_id}: {self.type} has no {', '.join(unknown)}")
        if not self.weight >= 0:
            raise ValueError(f"{self.predicate_id}: a weight can't be negative")


def from_rows(rows: DataFrame, most: int = 10_000) -> list[Predicate]:
    """The predicates of a table; it is a configuration, and more than ``most`` rows are an error. A null weight is 1, a null enabled true."""
    found = rows.select("definition_id", "predicate_id", "type", "params", "weight", "enabled").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} predicates")
    given = lambda v, default: default if v is None else v
    out = [Predicate(r[0], r[1], r[2], json.loads(r[3] or "{}"), given(r[4], 1.0), given(r[5], True)) for r in found]
    return sorted(out, key=lambda p: (p.definition_id, p.predicate_id))


def _count(category: str | None) -> str:
    return "annotation_count" if category is None else f"_n_{category.encode().hex()}"


def with_counts(scenes: DataFrame, annotations: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """``scenes`` with the object counts of the categories that the predicates name, from one aggregation of ``annotations``; 0 where there are none."""
    wanted = sorted({str(p.params["category"]) for p in predicates if p.type == "object_count" and p.params.get("category") is not None})
    if not wanted:
        return scenes
    counts = annotations.where(F.col("category").isin(*wanted)).groupBy("scene_id").agg(*[F.count_if(F.col("category") == c).alias(_count(c)) for c in wanted])
    return scenes.join(counts, "scene_id", "left").na.fill(0, [_count(c) for c in wanted])


def condition(p: Predicate, scenes: DataFrame, open_columns: Sequence[str]) -> Column:
    """A boolean, never null. Bounds that are not given don't bind, and lists that are empty hold for every scene.

    Tags, and categories, need one in common; channels need all. A custom expression sees ``open_columns`` alone and must be
    a boolean of one row.
    """
    within = lambda c, low, high: (F.lit(True) if low is None else F.col(c) >= F.lit(low)) & (F.lit(True) if high is None else F.col(c) <= F.lit(high))
    array = lambda values: F.array(*[F.lit(v) for v in values])
    v = p.params
    if p.type in ("tag", "category"):
        column, values = ("tags", v.get("tags")) if p.type == "tag" else ("categories", v.get("categories"))
        out = F.arrays_overlap(column, array(values)) if values else F.lit(True)
    elif p.type == "sensor_channel":
        values = v.get("required_channels")
        out = F.size(F.array_except(array(values), F.col("channels"))) == 0 if values else F.lit(True)
    elif p.type == "time_range":
        out = within("end_us", v.get("start_timestamp_us"), None) & within("start_us", None, v.get("end_timestamp_us"))
    elif p.type == "object_count":
        out = within(f"`{_count(v.get('category'))}`", v.get("min_count"), v.get("max_count"))
    elif p.type == "ego_speed":
        out = within("max_speed", v.get("min_speed_mps"), v.get("max_speed_mps"))
    else:
        if not v.get("expression"):
            raise ValueError(f"{p.predicate_id}: no expression")
        # Spark analyses it over the open columns of no rows, so names, types and aggregates are checked before use.
        text = str(v["expression"])
        if re.search(r"\bselect\b", text, re.I):
            raise ValueError(f"{p.predicate_id}: an expression is of one row")
        seen = scenes.select(*[c for c in open_columns if c in scenes.columns]).where(F.expr(text)).select(F.expr(text).alias("holds"))
        if seen.schema["holds"].dataType.typeName() not in ("boolean", "void"):
            raise ValueError(f"{p.predicate_id}: an expression is a boolean")
        out = F.expr(text).cast("boolean")
    return F.coalesce(out, F.lit(False))


def evaluate(scenes: DataFrame, annotations: DataFrame, predicates: Sequence[Predicate], open_columns: Sequence[str] = ()) -> DataFrame:
    """definition_id, scene_id, matched and failed (ids of enabled predicates, sorted), score and passes for each scene and definition.

    score is the weight of what matches, as a share of all weight; without weight it is 1 if all match, else 0. passes is true if
    all match. A definition whose predicates are all disabled matches every scene with a score of 1.
    """
    counted = with_counts(scenes, annotations, [p for p in predicates if p.enabled])
    results = []
    for definition in sorted({p.definition_id for p in predicates}):
        own = [p for p in predicates if p.definition_id == definition and p.enabled]
        each = [F.struct(F.lit(p.predicate_id).alias("id"), F.lit(float(p.weight)).alias("weight"), condition(p, scenes, open_columns).alias("holds")) for p in own]
        kind = "array<struct<id:string,weight:double,holds:boolean>>"
        results.append(F.struct(F.lit(definition).alias("definition_id"), (F.array(*each) if each else F.array()).cast(kind).alias("each")))
    if not results:
        return scenes.sparkSession.createDataFrame([], "definition_id string, scene_id string, matched array<string>, failed array<string>, score double, passes boolean")
    rows = counted.select("scene_id", F.explode(F.array(*results)).alias("r")).select("r.definition_id", "scene_id", "r.each")
    ids = lambda holds: F.sort_array(F.transform(F.filter("each", lambda e: e["holds"] == holds), lambda e: e["id"]))
    weight = lambda only: F.aggregate("each", F.lit(0.0), lambda s, e: s + F.when(e["holds"] | F.lit(not only), e["weight"]).otherwise(0.0))
    out = rows.select("definition_id", "scene_id", ids(True).alias("matched"), ids(False).alias("failed"), weight(True).alias("_own"), weight(False).alias("_all"))
    passes = F.size("failed") == 0
    return out.select("definition_id", "scene_id", "matched", "failed", F.when(F.col("_all") > 0, F.col("_own") / F.col("_all")).otherwise(passes.cast("double")).alias("score"), passes.alias("passes"))
