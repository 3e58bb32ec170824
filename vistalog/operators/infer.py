"""The inference stage: a user's model over batches of images, loaded once a worker, and the clean-up of its output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model's labels that count, and the categories they name.
LABELS = {"barrier": "movable_object.barrier", "car": "vehicle.car", "person": "human.pedestrian.adult"}
BACKENDS: dict[str, Callable[..., Callable[[list[str]], list[list[dict]]]]] = {}
DETECTION = "array<struct<label:string,score:double,x1:double,y1:double,x2:double,y2:double>>"


def backend(name: str) -> Callable:
    """Register a backend: a function of parameters that loads a model and returns what maps image URIs to detections."""

    def add(f: Callable) -> Callable:
        BACKENDS[name] = f
        return f

    return add


def detect(images: DataFrame, load: str | Callable, **parameters) -> DataFrame:
    """``images`` (image_uri and more) with detections: one model call a batch, the model loaded once a task."""
    if isinstance(load, str):
        if load not in BACKENDS:
            raise ValueError(f"unknown backend {load}; known: {', '.join(sorted(BACKENDS))}")
        load = BACKENDS[load]
    chosen = load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = chosen(**parameters)
        for pdf in batches:
            yield pdf.assign(detections=model(pdf["image_uri"].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
    return images.mapInPandas(run, f"{fields}, detections {DETECTION}")


def cleaned(detected: DataFrame) -> DataFrame:
    """A row for each detection of a known label: det_pos, category, score to 4 decimals and box to 1."""
    rows = detected.select("*", F.posexplode("detections").alias("raw_pos", "d")).drop("detections")
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    rows = rows.withColumn("category", F.try_element_at(names, F.lower(F.trim("d.label")))).where("category is not null")
    box = [F.round(f"d.{c}", 1).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return rows.select("*", F.round("d.score", 4).alias("score"), *box).drop("d")
