"""Queries over the scene catalog: validation, profiles, quality and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import validate as V
from .adapters import ctes, view

REQUIRED = ["CAM_FRONT", "LIDAR_TOP", "CAM_FRONT"]
_ALL = ("scenes", "scene_channels", "scene_runs", "sample_frames", "scene_calibrations", "scene_ego_poses")


def _v(spark, d, *names):
    return [view(spark, d, n) for n in names]


def _issues(spark, d, kinds=None):
    scenes, channels, frames, cal, pose = _v(spark, d, "scenes", "scene_channels", "sample_frames", "scene_calibrations", "scene_ego_poses")
    return V.issues(scenes, channels, frames, cal, pose, REQUIRED, kinds=kinds)


_REQ = "req as (select * from (values ('CAM_FRONT'), ('LIDAR_TOP'), ('CAM_FRONT')) r(channel))"
_RESOLVED = """resolved as (select f.*, c.calibration_id is not null as has_calibration, coalesce(c.has_intrinsic, false) as has_intrinsic, p.ego_pose_id is not null as has_pose
  from sample_frames f left join scene_calibrations c on c.scene_id = f.scene_id and c.calibration_id = f.calibration_id
  left join scene_ego_poses p on p.scene_id = f.scene_id and p.ego_pose_id = f.ego_pose_id)"""
_ISSUES = f"""with {ctes(*_ALL)}, {_REQ}, {_RESOLVED},
issues as (
  select scene_id, 'empty_scene' as type, null::varchar as channel, null::varchar as ref_id, true as blocking from scenes where sample_count = 0
  union all select s.scene_id, 'missing_channel', r.channel, null, true from scenes s cross join req r where not exists (select 1 from scene_channels c where c.scene_id = s.scene_id and c.channel = r.channel)
  union all select s.scene_id, 'sample_missing_channel', r.channel, s.sample_id, false from (select distinct scene_id, sample_id from sample_frames) s cross join req r
    where not exists (select 1 from sample_frames f where f.sample_id = s.sample_id and f.channel = r.channel)
  union all select scene_id, case when coalesce(calibration_id, '') = '' then 'missing_calibrated_sensor_ref' else 'missing_calibrated_sensor_record' end, channel, frame_id, false from resolved where coalesce(calibration_id, '') = '' or not has_calibration
  union all select scene_id, case when coalesce(ego_pose_id, '') = '' then 'missing_ego_pose_ref' else 'missing_ego_pose_record' end, channel, frame_id, false from resolved where coalesce(ego_pose_id, '') = '' or not has_pose
  union all select scene_id, 'missing_camera_intrinsic', channel, frame_id, false from resolved where modality = 'camera' and not has_intrinsic
  union all select scene_id, 'missing_image_size', channel, frame_id, false from resolved where modality = 'camera' and (width is null or height is null))"""
_VERDICTS = f"""{_ISSUES}, counts as (select scene_id, count(case when blocking then 1 end) as e, count(case when not blocking then 1 end) as w from issues group by scene_id),
verdicts as (select s.scene_id, case when coalesce(e, 0) > 0 then 'failed' when coalesce(w, 0) > 0 then 'warning' else 'ready' end as validation_status, coalesce(e, 0) as error_count, coalesce(w, 0) as warning_count
  from scenes s left join counts using (scene_id))"""


def _rule(*kinds):
    def query(spark, d):
        return _issues(spark, d, kinds)

    return query, f"{_ISSUES} select * from issues where type in ({', '.join(repr(k) for k in kinds)})"


def v_issues(spark, d):
    return _issues(spark, d)


def v8_verdicts(spark, d):
    return V.verdicts(view(spark, d, "scenes"), _issues(spark, d))


def v9_batch_verdict(spark, d):
    """The verdict over all scenes, over those without an error, over the spotless ones, and over none."""
    good = F.col("error_count") == 0
    batches = {"all": (F.lit(True), 2), "without errors": (good, 0), "spotless": (good & (F.col("warning_count") == 0), 0), "none": (F.col("error_count") < 0, 0)}
    out = V.batch_verdicts(v8_verdicts(spark, d), batches)
    return out.select(*[c for c in out.columns if c != "batch"], "batch")


V9 = f"""{_VERDICTS}, b as (select 'all' as batch, 2 as extra, * from verdicts union all select 'without errors', 0, * from verdicts where error_count = 0 union all select 'spotless', 0, * from verdicts where error_count = 0 and warning_count = 0),
names as (select * from (values ('all', 2), ('without errors', 0), ('spotless', 0), ('none', 0)) t(batch, extra)),
t as (select n.batch, count(b.batch) as scene_count, coalesce(sum(error_count), 0) + n.extra + case when count(b.batch) = 0 and n.extra = 0 then 1 else 0 end as e, coalesce(sum(warning_count), 0) as w from names n left join b on b.batch = n.batch group by n.batch, n.extra)
select batch, scene_count, case when e > 0 then 'failed' when w > 0 then 'warning' else 'ready' end as status, cast(e as bigint) as error_count, cast(w as bigint) as warning_count, cast(e + w as bigint) as issue_count from t"""


def v10_required_channels(spark, d):
    versions = view(spark, d, "scenes").join(view(spark, d, "scene_channels"), "scene_id").groupBy("dataset_id").agg(F.sort_array(F.collect_set("channel")).alias("version_channels"))
    given = F.when(F.col("dataset_id") == "ds-1", F.array(F.lit("CAM_FRONT"))).when(F.col("dataset_id") == "ds-2", F.array().cast("array<string>"))
    return versions.select("dataset_id", F.array_join(V.required_channels(given, F.col("version_channels")), ",").alias("required"))


V10 = f"""with {ctes('scenes', 'scene_channels')} select dataset_id, case when dataset_id = 'ds-1' then 'CAM_FRONT' else string_agg(distinct channel, ',' order by channel) end as required
from scenes join scene_channels using (scene_id) group by dataset_id"""


def v11_run_ids(spark, d):
    scenes = view(spark, d, "scenes")
    return scenes.select("scene_id", V.run_id("val-scene-", F.col("dataset_id"), F.col("scene_id")).alias("validation_run_id"), V.run_id("profile-scene-", F.col("dataset_id"), F.col("scene_id")).alias("profile_run_id"))


V11 = f"""with {ctes('scenes')} select scene_id, 'val-scene-' || substr(sha256(dataset_id || ':' || scene_id), 1, 12) as validation_run_id, 'profile-scene-' || substr(sha256(dataset_id || ':' || scene_id), 1, 12) as profile_run_id from scenes"""
GATE = [
    {"field": "should_block_pipeline", "truthy": True, "code": "blocked", "message": "validation blocks"},
    {"field": "validation_status", "equals": "failed", "code": "failed", "message": "validation failed"},
    {"field": "validation_status", "one_of": ["warning", "unknown"], "code": "warned", "message": "validation warns"},
]


def v12_gate(spark, d):
    return V.gate(view(spark, d, "scene_runs"), GATE).select("run_id", "type", "created_us", "blocked", "code", "message")


V12 = f"""with {ctes('scene_runs')}, c as (select *, case when should_block_pipeline then 'blocked' when validation_status = 'failed' then 'failed' when validation_status in ('warning', 'unknown') then 'warned' end as code from scene_runs)
select run_id, type, created_us, code is not null as blocked, code, case code when 'blocked' then 'validation blocks' when 'failed' then 'validation failed' when 'warned' then 'validation warns' end as message from c"""


def p1_category_histogram(spark, d):
    return P.category_histogram(view(spark, d, "annotations"))


def _coverage(spark, d):
    return P.coverage(V.resolved(*_v(spark, d, "sample_frames", "scene_calibrations", "scene_ego_poses")))


_COVERAGE = f"""with {ctes(*_ALL)}, {_RESOLVED},
coverage as (select scene_id, channel, count(*) as frame_count, count(case when has_calibration then 1 end) / count(*)::double as calibration_coverage, count(case when has_pose then 1 end) / count(*)::double as ego_pose_coverage,
  case when bool_or(modality = 'camera') then count(case when modality = 'camera' and has_intrinsic then 1 end) / count(*)::double end as intrinsic_coverage,
  case when bool_or(modality = 'camera') then count(case when modality = 'camera' and width is not null and height is not null then 1 end) / count(*)::double end as image_size_coverage from resolved group by all)"""


def _covered(column):
    def query(spark, d):
        return _coverage(spark, d).where(F.col(column).isNotNull()).select("scene_id", "channel", "frame_count", column)

    return query, f"{_COVERAGE} select scene_id, channel, frame_count, {column} from coverage where {column} is not null"


def p6_totals(spark, d):
    out = P.totals(*_v(spark, d, "scenes", "scene_channels"))
    return out.withColumn("channels", F.array_join("channels", ","))


P6 = f"""with {ctes('scenes', 'scene_channels')} select count(*) as scene_count, cast(sum(sample_count) as bigint) as sample_count, cast(sum(frame_count) as bigint) as frame_count, cast(sum(annotation_count) as bigint) as annotation_count,
(select string_agg(distinct channel, ',' order by channel) from scene_channels semi join scenes using (scene_id)) as channels from scenes"""


def x8_channel_profile(spark, d):
    return P.channel_profile(view(spark, d, "sample_frames"))


X8 = f"""with {ctes('sample_frames')} select channel, count(distinct scene_id) as scene_count, count(distinct sample_id) as sample_count, count(*) as frame_count,
count(distinct scene_id) / (select count(distinct scene_id) from sample_frames)::double as scene_coverage from sample_frames group by channel"""


def q1_latest_runs(spark, d):
    return Q.latest_runs(view(spark, d, "scene_runs")).select("scene_id", "type", "run_id", "created_us")


_LATEST = "latest as (select * from (select *, row_number() over (partition by scene_id, type order by created_us desc, run_id) as rn from scene_runs) where rn = 1)"
Q1 = f"with {ctes('scene_runs')}, {_LATEST} select scene_id, type, run_id, created_us from latest"


def _quality(spark, d):
    return Q.scene_quality(*_v(spark, d, "scenes", "scene_runs"))


_QUALITY = f"""with {ctes('scenes', 'scene_runs', 'scene_channels')}, {_LATEST},
q as (select s.*, r.run_id, r.validation_status, coalesce(r.should_block_pipeline, false) or lower(r.validation_status) in ('failed', 'error') as blocks, s.status in ('validated', 'profiled') as good from scenes s left join (select * from latest where type = 'scene_validation') r using (scene_id)),
quality as (select *, case when not good or run_id is null then 'unknown' when blocks then 'blocked' when lower(validation_status) = 'warning' then 'warning' when lower(validation_status) = 'ready' then 'ready' else 'unknown' end as readiness,
  concat_ws(',', case when not good then 'scene_not_ready' end, case when run_id is null then 'validation_missing' when blocks then 'validation_blocked' end, case when not has_ground_truth or annotation_count <= 0 then 'missing_ground_truth' end) as exclusion_reasons from q)"""


def q2_readiness(spark, d):
    return _quality(spark, d).select("scene_id", "readiness")


def q3_selectability(spark, d):
    return _quality(spark, d).select("scene_id", "selectable", F.array_join("exclusion_reasons", ",").alias("exclusion_reasons"))


def q4_dataset_quality(spark, d):
    return Q.dataset_quality(_quality(spark, d)).drop("readiness", "ground_truth_coverage")


_D = "dataset_id, dataset_version, count(*) as scene_count"
Q4 = f"""{_QUALITY} select {_D}, count(case when readiness = 'ready' then 1 end) as ready_count, count(case when readiness = 'warning' then 1 end) as warning_count, count(case when readiness = 'blocked' then 1 end) as blocked_count, count(case when readiness = 'unknown' then 1 end) as unknown_count,
count(case when exclusion_reasons = '' then 1 end) as selectable_count, count(case when exclusion_reasons <> '' then 1 end) as not_selectable_count, count(case when has_ground_truth then 1 end) as ground_truth_count, count(case when annotation_count > 0 then 1 end) as annotated_count,
cast(sum(sample_count) as bigint) as sample_count, cast(sum(frame_count) as bigint) as frame_count, cast(sum(annotation_count) as bigint) as annotation_count from quality group by dataset_id, dataset_version"""


def q5_exclusions(spark, d):
    return Q.exclusion_histogram(_quality(spark, d))


Q5 = f"{_QUALITY} select dataset_id, reason, count(*) as scenes from (select dataset_id, unnest(string_split(exclusion_reasons, ',')) as reason from quality where exclusion_reasons <> '') group by all"


def q5_observed_channels(spark, d):
    out = Q.observed_channels(*_v(spark, d, "scenes", "scene_runs", "scene_channels"))
    return out.withColumn("channels", F.array_join("channels", ","))


Q5C = f"{_QUALITY} select dataset_id, string_agg(distinct channel, ',' order by channel) as channels from scenes semi join (select scene_id from scene_runs where type = 'scene_profile') using (scene_id) join scene_channels using (scene_id) group by dataset_id"


def q6_dataset_readiness(spark, d):
    return Q.dataset_quality(_quality(spark, d)).select("dataset_id", "readiness")


Q6 = f"""{_QUALITY} select dataset_id, case when count(case when readiness <> 'unknown' then 1 end) = 0 then 'unknown' when count(case when exclusion_reasons = '' then 1 end) = 0 then 'blocked'
when count(case when readiness <> 'ready' or exclusion_reasons <> '' then 1 end) > 0 then 'warning' else 'ready' end as readiness from quality group by dataset_id"""


def q7_ground_truth_coverage(spark, d):
    return Q.dataset_quality(_quality(spark, d)).select("dataset_id", "ground_truth_coverage")


Q7 = f"{_QUALITY} select dataset_id, round(count(case when has_ground_truth then 1 end) / count(*)::double, 4) as ground_truth_coverage from quality group by dataset_id"


def q8_quality_page(spark, d):
    return Q.quality_page(_quality(spark, d), 200, 100).select("scene_id", "dataset_id", "readiness", "all_scenes", "all_selectable")


Q8 = f"""{_QUALITY}, page as (select * from quality order by created_us desc, scene_id limit 200 offset 100), s as (select dataset_id, count(*) as all_scenes, count(case when exclusion_reasons = '' then 1 end) as all_selectable from quality group by dataset_id)
select scene_id, dataset_id, readiness, all_scenes, all_selectable from page join s using (dataset_id)"""


def c1_registered(spark, d):
    scenes = view(spark, d, "scenes").select("scene_id", "dataset_id", "status", "annotation_count")
    kept = scenes.where("status <> 'built'")
    fresh = scenes.where("annotation_count > 0").withColumn("status", F.lit("built"))
    tag = lambda df, name: df.withColumn("mode", F.lit(name))
    return tag(C.register(kept, fresh), "keep").union(tag(C.register(kept, fresh, replace_existing=True), "replace"))


C1 = f"""with {ctes('scenes')}, kept as (select scene_id, dataset_id, status, annotation_count from scenes where status <> 'built'), fresh as (select scene_id, dataset_id, 'built' as status, annotation_count from scenes where annotation_count > 0)
select *, 'keep' as mode from kept union all select *, 'keep' from fresh anti join kept using (scene_id) union all select *, 'replace' from kept anti join fresh using (scene_id) union all select *, 'replace' from fresh"""


def c2_scene_index(spark, d):
    scenes, channels = _v(spark, d, "scenes", "scene_channels")
    return C.scene_index(scenes, channels).select("scene_id", "dataset_id", "sample_count")


C2 = f"with {ctes('scenes', 'scene_channels')} select scene_id, dataset_id, sample_count from scenes semi join scene_channels using (scene_id)"


def c3_dataset_manifest(spark, d):
    out = C.dataset_manifest(*_v(spark, d, "scenes", "scene_channels"))
    return out.withColumn("channels", F.array_join("channels", ","))


C3 = f"""with {ctes('scenes', 'scene_channels')}, c as (select dataset_id, dataset_version, string_agg(distinct channel, ',' order by channel) as channels from scenes join scene_channels using (scene_id) group by all)
select {_D}, cast(sum(sample_count) as bigint) as sample_count, cast(sum(frame_count) as bigint) as frame_count, max(channels) as channels, 'ready' as status from scenes left join c using (dataset_id, dataset_version) group by dataset_id, dataset_version"""


def c4_status(spark, d):
    return C.with_status(*_v(spark, d, "scenes", "scene_runs")).select("scene_id", "status")


C4 = f"""with {ctes('scenes', 'scene_runs')}, l as (select * from (select scene_id, case when type = 'scene_profile' then 'profiled' when lower(validation_status) in ('failed', 'error') or should_block_pipeline then 'failed' else 'validated' end as new,
  row_number() over (partition by scene_id order by created_us desc, run_id desc, case when type = 'scene_profile' then 'profiled' when lower(validation_status) in ('failed', 'error') or should_block_pipeline then 'failed' else 'validated' end desc) as rn from scene_runs) where rn = 1)
select scene_id, coalesce(new, status) as status from scenes left join l using (scene_id)"""


def c5_listing(spark, d):
    return C.listing(view(spark, d, "scenes"), {"dataset_id": "ds-2", "status": "profiled", "has_ground_truth": None}, id_column="scene_id", limit=100, offset=50).select("scene_id", "created_us")


C5 = f"with {ctes('scenes')} select scene_id, created_us from scenes where dataset_id = 'ds-2' and status = 'profiled' order by created_us desc, scene_id limit 100 offset 50"


def c6_patched(spark, d):
    scenes = view(spark, d, "scenes").select("scene_id", "status", "annotation_count")
    patch = scenes.where("annotation_count > 1").select("scene_id", F.when(F.col("annotation_count") > 2, "checked").alias("status"), F.lit(None).cast("long").alias("annotation_count"))
    return C.patched(scenes, patch, ["scene_id"])


C6 = f"with {ctes('scenes')} select scene_id, case when annotation_count > 2 then 'checked' else status end as status, annotation_count from scenes"

QUERIES = {
    "v_issues": (v_issues, f"{_ISSUES} select * from issues"),
    "v1_empty_scenes": _rule("empty_scene"),
    "v2_missing_channels": _rule("missing_channel"),
    "v3_sample_missing_channels": _rule("sample_missing_channel"),
    "v4_calibration_issues": _rule("missing_calibrated_sensor_ref", "missing_calibrated_sensor_record"),
    "v5_ego_pose_issues": _rule("missing_ego_pose_ref", "missing_ego_pose_record"),
    "v6_intrinsic_issues": _rule("missing_camera_intrinsic"),
    "v7_image_size_issues": _rule("missing_image_size"),
    "v8_verdicts": (v8_verdicts, f"{_VERDICTS} select * from verdicts"),
    "v9_batch_verdict": (v9_batch_verdict, V9),
    "v10_required_channels": (v10_required_channels, V10),
    "v11_run_ids": (v11_run_ids, V11),
    "v12_gate": (v12_gate, V12),
    "p1_category_histogram": (p1_category_histogram, f"with {ctes('annotations')} select scene_id, coalesce(nullif(category, ''), 'unknown') as category, count(*) as annotation_count from annotations group by all"),
    "p2_calibration_coverage": _covered("calibration_coverage"),
    "p3_ego_pose_coverage": _covered("ego_pose_coverage"),
    "p4_intrinsic_coverage": _covered("intrinsic_coverage"),
    "p5_image_size_coverage": _covered("image_size_coverage"),
    "p6_totals": (p6_totals, P6),
    "x8_channel_profile": (x8_channel_profile, X8),
    "q1_latest_runs": (q1_latest_runs, Q1),
    "q2_readiness": (q2_readiness, f"{_QUALITY} select scene_id, readiness from quality"),
    "q3_selectability": (q3_selectability, f"{_QUALITY} select scene_id, exclusion_reasons = '' as selectable, exclusion_reasons from quality"),
    "q4_dataset_quality": (q4_dataset_quality, Q4),
    "q5_exclusions": (q5_exclusions, Q5),
    "q5_observed_channels": (q5_observed_channels, Q5C),
    "q6_dataset_readiness": (q6_dataset_readiness, Q6),
    "q7_ground_truth_coverage": (q7_ground_truth_coverage, Q7),
    "q8_quality_page": (q8_quality_page, Q8),
    "c1_registered": (c1_registered, C1),
    "c2_scene_index": (c2_scene_index, C2),
    "c3_dataset_manifest": (c3_dataset_manifest, C3),
    "c4_status": (c4_status, C4),
    "c5_listing": (c5_listing, C5),
    "c6_patched": (c6_patched, C6),
}
