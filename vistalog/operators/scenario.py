"""Scenario mining, readiness scores, predicates and selection strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .totals import with_totals

#: Filters that a profile sets unless the caller does.
PROFILES: dict[str, dict] = {"detection_ready": {"has_ground_truth": True, "min_annotation_count": 1, "validated": True}, "no_gt_candidates": {"has_ground_truth": False}, "dense_gt": {"has_ground_truth": True}, "all": {}}


def with_candidate_columns(scenes: DataFrame) -> DataFrame:
    """selectable and validation_status of catalog scenes."""
    status = F.when(F.col("status").isin("validated", "profiled"), "ready").when(F.col("status") == "failed", "blocked").otherwise("unknown")
    return scenes.withColumn("selectable", F.coalesce("has_ground_truth", F.lit(False)) & (F.col("annotation_count") > 0)).withColumn("validation_status", status)


def filter_reasons(profile: str = "all", required_channels: Sequence[str] = (), **given) -> Column:
    """Every filter that a candidate fails, in order; a given value, 0 and False too, wins over the profile's."""
    want = {**PROFILES.get(profile, {}), **{k: v for k, v in given.items() if v is not None}}
    reasons = []
    if "has_ground_truth" in want:
        reasons.append(F.when(F.coalesce("has_ground_truth", F.lit(False)) != want["has_ground_truth"], "gt_mismatch"))
    if "min_annotation_count" in want:
        reasons.append(F.when(F.col("annotation_count") < want["min_annotation_count"], "annotation_count_below_min"))
    if "max_annotation_count" in want:
        reasons.append(F.when(F.col("annotation_count") > want["max_annotation_count"], "annotation_count_above_max"))
    if want.get("validated"):
        reasons.append(F.when(~F.col("status").isin("validated", "profiled"), "not_validated"))
    if required_channels:
        lost = F.filter(F.array(*[F.lit(c) for c in required_channels]), lambda c: ~F.array_contains("channels", c))
        reasons.append(F.when(F.size(lost) > 0, F.concat(F.lit("missing_channels:"), F.array_join(lost, ","))))
    if "selectable" in want:
        reasons.append(F.when(F.col("selectable") != want["selectable"], "selectable_for_detection_mismatch"))
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def mine(candidates: DataFrame, sort_by: str = "annotation_count", order: str = "desc", max_candidates: int = 50, **filters) -> DataFrame:
    """The first candidates that pass, sorted, ties in catalog order (newest first); an unknown key is annotation_count."""
    key = sort_by if sort_by in ("annotation_count", "sample_count", "frame_count", "scene_id") else "annotation_count"
    passed = candidates.where(F.size(filter_reasons(**filters)) == 0)
    return passed.orderBy(F.col(key).asc() if order == "asc" else F.col(key).desc(), F.col("created_us").desc(), "scene_id").limit(max_candidates)


def rejected(candidates: DataFrame, **filters) -> DataFrame:
    """Candidates that fail a filter, with all reasons; those beyond a cap are not among them."""
    return candidates.withColumn("reasons", filter_reasons(**filters)).where(F.size("reasons") > 0)


def score(candidates: DataFrame, required_channels: Sequence[str] = ()) -> DataFrame:
    """Readiness score, its ordered reasons and bucket.

    Ground truth .30, validation .25 or .15, channels .20 or .10, density up to .15 against the densest, completeness .10.
    """
    c = with_totals(candidates, candidates.agg(F.max("annotation_count").alias("most")))
    gt = F.when(F.col("selectable"), F.lit(0.30)).otherwise(F.lit(0.0))
    valid = F.when(F.col("validation_status") == "ready", F.lit(0.25)).when(F.col("validation_status") == "warning", F.lit(0.15)).otherwise(F.lit(0.0))
    if required_channels:
        n = F.size(F.filter(F.array(*[F.lit(x) for x in required_channels]), lambda x: F.array_contains("channels", x)))
        channels = F.when(n == len(required_channels), F.lit(0.20)).when(n > 0, F.lit(0.10)).otherwise(F.lit(0.0))
    else:
        channels = F.lit(0.20)
    density = F.when(F.col("most") > 0, F.round(F.least(F.lit(0.15), F.lit(0.15) * F.col("annotation_count") / F.col("most")), 4)).otherwise(F.lit(0.0))
    whole = F.when((F.col("sample_count") > 0) & (F.col("frame_count") > 0), F.lit(0.10)).otherwise(F.lit(0.0))
    reached = F.when(channels == 0.20, "required_channels_present").when(channels > 0, "partial_channels_present") if required_channels else F.lit("no_channel_requirements")
    reasons = F.array_compact(F.array(
        F.when(gt > 0, "has_ground_truth"), F.when(valid > 0, F.concat(F.lit("validation_"), "validation_status")), reached,
        F.when((F.col("most") > 0) & (F.col("annotation_count") > 0), "dense_annotations"), F.when(whole > 0, "complete_sequence"),
    ))
    out = c.withColumn("score", F.round(gt + valid + channels + density + whole, 4)).withColumn("reasons", reasons).drop("most")
    return out.withColumn("bucket", bucket(F.col("score")))


def bucket(value: Column) -> Column:
    return F.when(value >= 0.75, "ready").when(value >= 0.40, "warning").otherwise("blocked")


def score_rollup(scored: DataFrame, top: int = 5) -> DataFrame:
    """Counts by bucket, the average score, null without rows, and the best ready scenes, in one row."""
    is_ = lambda b: F.count_if(F.col("bucket") == b).alias(f"{b}_count")
    counts = scored.agg(F.count("*").alias("scored_count"), is_("ready"), is_("warning"), is_("blocked"), F.round(F.avg("score"), 4).alias("average_score")).withColumn("k", F.lit(1))
    best = scored.where("bucket = 'ready'").orderBy(F.col("score").desc(), "candidate_pos").limit(top)
    ids = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "candidate_pos", "scene_id"))).alias("b")).withColumn("k", F.lit(1))
    return counts.join(ids, "k").withColumn("top_scene_ids", F.transform("b", lambda x: x["scene_id"])).drop("k", "b")


def predicate(kind: str, **p) -> Column:
    """A scene predicate: tag, category, channel, time_range, object_count, ego_speed or expression."""
    any_of = lambda column, values: F.arrays_overlap(column, F.array(*[F.lit(v) for v in values]))
    within = lambda column, low, high: (F.col(column) >= low if low is not None else F.lit(True)) & (F.col(column) <= high if high is not None else F.lit(True))
    if kind in ("tag", "category", "channel"):
        return any_of({"tag": "tags", "category": "categories", "channel": "channels"}[kind], p["values"])
    if kind == "time_range":
        return (F.col("end_us") >= p["start_us"]) & (F.col("start_us") <= p["end_us"])
    if kind == "object_count":
        return within("annotation_count", p.get("min"), p.get("max"))
    if kind == "ego_speed":
        return within("max_speed", p.get("min"), p.get("max"))
    if kind == "expression":
        return F.expr(p["sql"])
    raise ValueError(f"unknown predicate {kind}")


def ego_speed(poses: DataFrame, key: str = "scene_id") -> DataFrame:
    """Largest speed between consecutive poses of a scene along the axes x, y and z that they have, in units a second; poses of
    equal time have none."""
    w = Window.partitionBy(key).orderBy("timestamp_us", "pos")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    axes = [c for c in "xyz" if c in poses.columns]
    way = F.abs(step(axes[0])) if len(axes) == 1 else F.sqrt(sum(step(c) * step(c) for c in axes))
    speeds = poses.withColumn("_d", way).withColumn("_t", step("timestamp_us"))
    return speeds.groupBy(key).agg(F.max(F.try_divide(F.col("_d") * 1_000_000, F.nullif("_t", F.lit(0)))).alias("max_speed"))


def choose(candidates: DataFrame, strategy: str, config: Mapping | None = None) -> DataFrame:
    """Pick candidates: top_k by score, threshold, balanced (per value of a column) or diversity (round robin over it)."""
    c = dict(config or {})
    order = (F.col(c.get("score", "score")).desc(), F.col("scene_id"))
    if strategy == "top_k":
        return candidates.orderBy(*order).limit(c["k"])
    if strategy == "threshold":
        return candidates.where(F.col(c.get("score", "score")) >= c["least"])
    rank = F.row_number().over(Window.partitionBy(c["by"]).orderBy(*order)) if strategy in ("balanced", "diversity") else None
    if strategy == "balanced":
        return candidates.withColumn("_n", rank).where(F.col("_n") <= c["per_value"]).drop("_n")
    if strategy == "diversity":
        return candidates.withColumn("_n", rank).orderBy("_n", *order).limit(c["k"]).drop("_n")
    raise ValueError(f"unknown strategy {strategy}")
