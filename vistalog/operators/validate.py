"""Validation of scenes: rules that yield issue rows, verdicts over them, and gates over results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an issue.
ISSUE = ("scene_id", "type", "channel", "ref_id", "blocking")


def _issue(df: DataFrame, kind: str, channel: Column | None = None, ref: Column | None = None, blocking: Column | bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("scene_id", F.lit(kind).alias("type"), (none if channel is None else channel).alias("channel"), (none if ref is None else ref).alias("ref_id"), (F.lit(blocking) if isinstance(blocking, bool) else blocking).alias("blocking"))


def empty_scenes(scenes: DataFrame) -> DataFrame:
    return _issue(scenes.where("sample_count = 0"), "empty_scene", blocking=True)


def _has(required: Sequence[str]) -> list[Column]:
    """Aggregates has0, has1, ... of rows with a channel: whether each of ``required`` is among them."""
    return [F.coalesce(F.bool_or(F.col("channel") == c), F.lit(False)).alias(f"has{i}") for i, c in enumerate(required)]


def _lost(required: Sequence[str]) -> Column:
    """A row for each of ``required``, repeated ones too, whose has is false or null."""
    each = [F.struct(F.lit(c).alias("channel"), F.coalesce(F.col(f"has{i}"), F.lit(False)).alias("has")) for i, c in enumerate(required)]
    return F.explode(F.transform(F.filter(F.array(*each), lambda x: ~x["has"]), lambda x: x["channel"])).alias("channel")


def missing_channels(scenes: DataFrame, scene_channels: DataFrame, required: Sequence[str]) -> DataFrame:
    """A blocking issue for each required channel, repeated ones too, that a scene lacks."""
    if not required:
        return _issue(scenes.limit(0), "missing_channel", blocking=True)
    found = scene_channels.groupBy("scene_id").agg(*_has(required))
    return _issue(scenes.select("scene_id").join(found, "scene_id", "left").select("scene_id", _lost(required)), "missing_channel", F.col("channel"), blocking=True)


def sample_missing_channels(frames: DataFrame, required: Sequence[str], block: bool = False) -> DataFrame:
    """An issue for each sample and required channel without a frame; a sample in several scenes has the frames of all.

    One aggregation by sample, so a frame is shuffled once.
    """
    found = frames.groupBy("sample_id").agg(F.collect_set(F.struct("scene_id")).alias("_scenes"), *_has(required))
    found = found.withColumns({f"has{i}": F.col(f"has{i}") & F.col("sample_id").isNotNull() for i in range(len(required))})
    rows = found.select("sample_id", "_scenes", _lost(required)).select("sample_id", "channel", F.explode("_scenes.scene_id").alias("scene_id"))
    return _issue(rows, "sample_missing_channel", F.col("channel"), F.col("sample_id"), block)


def resolved(frames: DataFrame, calibrations: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with what their references lead to: has_calibration, has_intrinsic and has_pose. Empty references are missing ones."""
    cal = calibrations.groupBy("scene_id", "calibration_id").agg(F.bool_or("has_intrinsic").alias("has_intrinsic")).withColumn("has_calibration", F.lit(True))
    pose = poses.select("scene_id", "ego_pose_id").distinct().withColumn("has_pose", F.lit(True))
    out = frames.join(cal, ["scene_id", "calibration_id"], "left").join(pose, ["scene_id", "ego_pose_id"], "left")
    return out.fillna(False, ["has_calibration", "has_intrinsic", "has_pose"])


def frame_issues(found: DataFrame) -> DataFrame:
    """Missing references, records, intrinsics and image sizes of resolved() frames; a frame may have several."""
    camera = F.col("modality") == "camera"
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kinds = F.array(
        F.when(~given("calibration_id"), "missing_calibrated_sensor_ref").when(~F.col("has_calibration"), "missing_calibrated_sensor_record"),
        F.when(~given("ego_pose_id"), "missing_ego_pose_ref").when(~F.col("has_pose"), "missing_ego_pose_record"),
        F.when(camera & ~F.col("has_intrinsic"), "missing_camera_intrinsic"),
        F.when(camera & (F.col("width").isNull() | F.col("height").isNull()), "missing_image_size"),
    )
    rows = found.select("scene_id", "channel", "frame_id", F.explode(F.array_compact(kinds)).alias("type"))
    return rows.select("scene_id", "type", "channel", F.col("frame_id").alias("ref_id"), F.lit(False).alias("blocking"))


def issues(scenes: DataFrame, scene_channels: DataFrame, frames: DataFrame, calibrations: DataFrame, poses: DataFrame, required: Sequence[str] = (), validate_samples: bool = True, block_on_samples: bool = False, kinds: Sequence[str] | None = None) -> DataFrame:
    """Every rule's issues; with ``kinds`` those types alone, and only rules that can yield them read their tables."""
    rules = {"empty_scene": lambda: empty_scenes(scenes), "missing_channel": lambda: missing_channels(scenes, scene_channels, required), "": lambda: frame_issues(resolved(frames, calibrations, poses))}
    if validate_samples and required:
        rules["sample_missing_channel"] = lambda: sample_missing_channels(frames, required, block_on_samples)
    own = [rule for kind, rule in rules.items() if kinds is None or kind in kinds or not kind and set(kinds) - set(rules)]
    out = reduce(DataFrame.unionByName, [rule() for rule in own]) if own else empty_scenes(scenes.limit(0))
    return out if kinds is None else out.where(F.col("type").isin(*kinds))


def verdicts(scenes: DataFrame, found: DataFrame) -> DataFrame:
    """validation_status, error_count and warning_count of every scene: failed if an issue blocks, warning if there is one, else ready."""
    counts = found.groupBy("scene_id").agg(F.count_if("blocking").alias("errors"), F.count_if(~F.col("blocking")).alias("warnings"))
    out = scenes.select("scene_id").join(counts, "scene_id", "left").fillna(0, ["errors", "warnings"])
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("ready")
    return out.select("scene_id", status.alias("validation_status"), F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count"))


def batch_verdicts(verdict: DataFrame, batches: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """A row for each batch (name to condition and number of unreadable manifests) over the scenes for which its condition holds, in one pass.

    An unreadable manifest is a blocking issue, and no scene at all is one too.
    """
    sums = lambda c, holds: F.coalesce(F.sum(F.when(holds, F.col(c))), F.lit(0)).cast("long")
    each = [F.struct(F.lit(name).alias("batch"), F.lit(n).cast("long").alias("unreadable"), F.count_if(holds).alias("scene_count"), sums("error_count", holds).alias("e"), sums("warning_count", holds).alias("w")) for name, (holds, n) in batches.items()]
    total = verdict.agg(F.array(*each).alias("_batches")).select(F.inline("_batches"))
    errors = F.col("e") + F.col("unreadable") + F.when((F.col("scene_count") == 0) & (F.col("unreadable") == 0), 1).otherwise(0)
    status = F.when(errors > 0, "failed").when(F.col("w") > 0, "warning").otherwise("ready")
    return total.select("batch", "scene_count", status.alias("status"), errors.cast("long").alias("error_count"), F.col("w").alias("warning_count"), (errors + F.col("w")).cast("long").alias("issue_count"))


def batch_verdict(verdict: DataFrame, unreadable: int = 0) -> DataFrame:
    """One row over all scenes; an unreadable manifest is a blocking issue, and no scene at all is one too."""
    return batch_verdicts(verdict, {"all": (F.lit(True), unreadable)}).drop("batch")


def required_channels(given: Column, version: Column) -> Column:
    """The caller's channels, or the dataset version's if none are given."""
    return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(version)


def run_id(prefix: str, job: Column, scene: Column) -> Column:
    """Prefix and the first twelve hex digits of a hash of job and scene: the same in each retry."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", job, scene), 256), 1, 12))


def gate(results: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Results with blocked, code and message of the first rule that holds.

    A rule has field, code, message and one of truthy (true), equals or one_of. A missing value holds only for a rule
    that asks for null.
    """
    chain_code = chain_message = None
    for rule in rules:
        value = F.col(rule["field"])
        if rule.get("truthy"):
            kind = results.schema[rule["field"]].dataType.typeName()
            holds = value if kind == "boolean" else value != "" if kind == "string" else value != 0
        elif "equals" in rule:
            holds = value.eqNullSafe(F.lit(rule["equals"]))
        else:
            holds = value.isin(*[v for v in rule["one_of"] if v is not None])
            if None in rule["one_of"]:
                holds = value.isNull() | holds
        holds = F.coalesce(holds, F.lit(False))
        chain_code = F.when(holds, rule["code"]) if chain_code is None else chain_code.when(holds, rule["code"])
        chain_message = F.when(holds, rule["message"]) if chain_message is None else chain_message.when(holds, rule["message"])
    none = F.lit(None).cast("string")
    out = results.withColumn("code", none if chain_code is None else chain_code).withColumn("message", none if chain_message is None else chain_message)
    return out.withColumn("blocked", F.col("code").isNotNull())
