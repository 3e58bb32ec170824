"""Queries over detection runs: selection, matching, metrics and records."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import select as D
from ..operators import views as L
from .adapters import ctes, table, view

DISTANCE = 0.25
CLASSES = ("c1", "c2", "c3")


def _manifests(spark, d):
    scenes = view(spark, d, "scenes")
    has = view(spark, d, "scene_channels").select("scene_id").distinct().withColumn("has_manifest", F.lit(True))
    return scenes.join(has, "scene_id", "left").na.fill(False, ["has_manifest"]).withColumn("pos", F.col("scene_id").cast("long"))


_MANIFESTS = f"{ctes('scenes', 'scene_channels', 'sample_frames')}, m as (select s.*, cast(scene_id as bigint) as pos, scene_id in (select scene_id from scene_channels) as has_manifest from scenes s)"
_SELECTED = f"""with {_MANIFESTS}, r as (select *, case when not has_manifest then 'scene_manifest_not_found' when not has_ground_truth or annotation_count < 2 then 'scene_has_no_ground_truth' end as reason from m),
n as (select *, coalesce(sum(case when reason is null then 1 else 0 end) over (order by pos rows between unbounded preceding and 1 preceding), 0) as before from r),
selection as (select scene_id, pos, reason is null as selected, reason, sample_count, annotation_count from n)"""


def _selection(spark, d, most=None):
    return D.select_scenes(_manifests(spark, d), None, True, 2, None, most)


def d1_scene_selection(spark, d, most=None):
    return _selection(spark, d, most).select("scene_id", "selected", "reason")


def d2_selection_summary(spark, d, most=None):
    total = view(spark, d, "scenes").agg(F.count("*").alias("total_count"))
    return D.selection_summary(_selection(spark, d, most), total).withColumn("skipped_scene_ids", F.array_join("skipped_scene_ids", ","))


D2 = f"""{_SELECTED} select count(case when selected then 1 end) as selected_count, count(case when not selected then 1 end) as skipped_count, count(*) as inspected_count, (select count(*) from scenes) as total_count,
cast(sum(case when selected then sample_count else 0 end) as bigint) as sample_count, cast(sum(case when selected then annotation_count else 0 end) as bigint) as annotation_count,
(select string_agg(scene_id, ',' order by pos) from (select scene_id, pos from selection where not selected order by pos limit 100)) as skipped_scene_ids from selection"""


def _placed(spark, d):
    f = view(spark, d, "sample_frames")
    return f.withColumn("pos", F.crc32(F.col("frame_id").cast("binary"))).withColumn("scene_pos", F.col("scene_id").cast("long")).withColumn("sample_pos", F.substring_index("sample_id", "-s", -1).cast("long"))


def d3_samples(spark, d, most=None):
    frames = _placed(spark, d).withColumn("pos", F.col("frame_id"))
    return D.select_samples(frames, "CAM_FRONT", True, most).select("scene_id", "sample_id", "camera_frame_id", "lidar_frame_id")


D3 = f"""with {_MANIFESTS}, c as (select scene_id, sample_id, max(frame_id) as camera_frame_id from sample_frames where channel = 'CAM_FRONT' group by all), l as (select scene_id, sample_id, max(frame_id) as lidar_frame_id from sample_frames where channel = 'LIDAR_TOP' group by all)
select scene_id, sample_id, camera_frame_id, lidar_frame_id from c left join l using (scene_id, sample_id) order by cast(scene_id as bigint), cast(split_part(sample_id, '-s', 2) as bigint)"""


def s5_first_samples(spark, d):
    samples = _placed(spark, d).select("scene_id", "sample_id", "scene_pos", "sample_pos").distinct()
    return D.first_samples(samples, 5000).select("scene_id", "sample_id")


S5 = f"with {_MANIFESTS} select scene_id, sample_id from (select distinct scene_id, sample_id from sample_frames) order by cast(scene_id as bigint), cast(split_part(sample_id, '-s', 2) as bigint) limit 5000"


def d7_prediction_counters(spark, d):
    s = F.coalesce("lifting_status", F.lit("succeeded"))
    p = view(spark, d, "predictions")
    return p.groupBy("scene_id").agg(F.count("*").alias("predictions"), F.count_if(s != "failed").alias("evaluable"), F.count_if(s == "succeeded").alias("succeeded"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "not_applicable").alias("not_applicable"))


D7 = f"""with {ctes('predictions')}, p as (select scene_id, coalesce(lifting_status, 'succeeded') as s from predictions)
select scene_id, count(*) as predictions, count(case when s <> 'failed' then 1 end) as evaluable, count(case when s = 'succeeded' then 1 end) as succeeded, count(case when s = 'failed' then 1 end) as failed, count(case when s = 'not_applicable' then 1 end) as not_applicable from p group by scene_id"""


def d14_run_rollup(spark, d):
    runs = view(spark, d, "sample_frames").withColumn("latency", F.coalesce(F.col("width"), F.lit(100)).cast("double"))
    return runs.where("channel = 'CAM_FRONT'").agg(F.countDistinct("scene_id").alias("scenes"), F.countDistinct("sample_id").alias("samples"), F.count("*").alias("requests"), F.round(F.avg("latency"), 6).alias("average_latency"), F.max("latency").alias("maximum_latency"))


D14 = f"""with {ctes('sample_frames')} select count(distinct scene_id) as scenes, count(distinct sample_id) as samples, count(*) as requests, round(avg(coalesce(width, 100)::double), 6) as average_latency, max(coalesce(width, 100)::double) as maximum_latency from sample_frames where channel = 'CAM_FRONT'"""


def d15_admission_errors(spark, d):
    scenes = view(spark, d, "scenes")
    requests = scenes.select(F.col("scene_id").alias("request_id"), "dataset_id", F.when(F.col("annotation_count") > 3, "v2").otherwise("v1").alias("dataset_version"), F.concat(F.lit("m"), (F.col("frame_count") % 9).cast("string")).alias("model_version_id"), F.lit("onnx").alias("backend"))
    versions = scenes.groupBy("dataset_id", "dataset_version").agg(F.when(F.col("dataset_id") == "ds-3", "draft").otherwise("ready").alias("status"), F.when(F.col("dataset_id") != "ds-4", "uri").alias("manifest_uri"))
    models = view(spark, d, "evaluation_runs").groupBy(F.col("model_id").alias("model_version_id")).agg(F.when(F.col("model_id") == "m2", "torch").otherwise("onnx").alias("backend"))
    return D.admission_errors(requests, versions, models)


D15 = f"""with {ctes('scenes', 'evaluation_runs')}, r as (select scene_id as request_id, dataset_id, case when annotation_count > 3 then 'v2' else 'v1' end as dataset_version, 'm' || cast(frame_count % 9 as varchar) as model_version_id from scenes),
m as (select distinct model_id from evaluation_runs), x as (select unnest([case when dataset_version = 'v2' then 'dataset_version_not_found' when dataset_id = 'ds-3' then 'dataset_version_not_ready' when dataset_id = 'ds-4' then 'dataset_manifest_missing' end,
  case when model_id is null then 'model_version_not_found' when model_id = 'm2' then 'model_backend_mismatch' end]) as code, request_id from r left join m on model_id = model_version_id) select request_id, code from x where code is not null"""


def _gt(spark, d):
    return E.supported(view(spark, d, "annotations"), CLASSES)


def _good(spark, d):
    return E.evaluable(view(spark, d, "predictions"))


_BOXES = f"""{ctes('annotations', 'predictions')}, gt as (select * from annotations where category in ('c1', 'c2', 'c3')), good as (select * from predictions where coalesce(lifting_status, '') <> 'failed'),
pairs as (select p.sample_id, p.category, p.prediction_id, g.annotation_id, pred_pos, gt_pos, sqrt((p.x-g.x)*(p.x-g.x) + (p.y-g.y)*(p.y-g.y) + (p.z-g.z)*(p.z-g.z)) as distance from good p join gt g on p.sample_id = g.sample_id and p.category = g.category),
near as (select * from pairs where distance <= {DISTANCE}),
asked as (select *, dense_rank() over (partition by sample_id, category order by pred_pos) as k from near),
walk as (
  select sample_id, category, 0 as k, []::bigint[] as taken, null::varchar as prediction_id, null::varchar as annotation_id, null::double as distance from (select distinct sample_id, category from asked)
  union all
  select w.sample_id, w.category, w.k + 1, case when b.gt_pos is null then w.taken else list_append(w.taken, b.gt_pos) end, b.prediction_id, b.annotation_id, b.distance
  from walk w join (select distinct sample_id, category, k from asked) n on n.sample_id = w.sample_id and n.category = w.category and n.k = w.k + 1
  left join lateral (select a.gt_pos, a.prediction_id, a.annotation_id, a.distance from asked a where a.sample_id = w.sample_id and a.category = w.category and a.k = w.k + 1 and not list_contains(w.taken, a.gt_pos) order by a.distance, a.gt_pos limit 1) b on true),
matched as (select sample_id, category, prediction_id, annotation_id, round(distance, 6) as distance from walk where annotation_id is not null)"""


def _cells(by: str) -> str:
    return f"""g as (select {by}, count(*) as gt from gt group by all), p as (select {by}, count(*) as evaluable from good group by all), m as (select {by}, count(*) as tp, round(sum(distance), 6) as distance_sum from matched group by all),
c as (select coalesce(g.{by}, p.{by}) as {by}, coalesce(tp, 0) as tp, coalesce(evaluable, 0) - coalesce(tp, 0) as fp, coalesce(gt, 0) - coalesce(tp, 0) as fn, coalesce(distance_sum, 0.0) as distance_sum from g full join p on g.{by} = p.{by} left join m on m.{by} = coalesce(g.{by}, p.{by}))"""


_RATES = "round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall, round(coalesce(distance_sum / nullif(tp, 0), 0), 6) as mean_distance"


def e1_scene_index(spark, d):
    samples = view(spark, d, "sample_frames").groupBy("scene_id", "sample_id").agg(F.count_if(F.col("channel") == "RADAR_FRONT").alias("annotations"))
    scenes = view(spark, d, "scenes").withColumn("annotation_count", F.when(F.col("annotation_count") == 1, 0).otherwise(F.col("annotation_count")).cast("long")).withColumn("has_ground_truth", F.col("annotation_count") > 2)
    return E.scene_index(scenes, samples).select("scene_id", "sample_count", "annotation_count", "has_gt")


E1 = f"""with {ctes('scenes', 'sample_frames')}, a as (select scene_id, count(*) as n, cast(sum(x) as bigint) as x from (select scene_id, sample_id, count(case when channel = 'RADAR_FRONT' then 1 end) as x from sample_frames group by all) group by scene_id)
select scene_id, coalesce(nullif(sample_count, 0), n, 0) as sample_count, coalesce(nullif(case when annotation_count = 1 then 0 else annotation_count end, 0), x, 0) as annotation_count,
  annotation_count > 2 or coalesce(nullif(case when annotation_count = 1 then 0 else annotation_count end, 0), x, 0) > 0 as has_gt from scenes left join a using (scene_id)"""


def _shards(spark, d):
    p = view(spark, d, "predictions").select("scene_id", "sample_id").distinct()
    n = F.substring_index("sample_id", "-", -1).cast("long")
    scene = F.when(n % 7 == 0, "scene-unknown").otherwise(F.col("scene_id"))
    return p.select(scene.alias("scene_id"), "sample_id", F.when(n % 5 == 0, F.lit("scene-0")).otherwise(scene).alias("payload_scene_id"), F.when(n % 11 == 0, F.lit("sample-0")).otherwise(F.col("sample_id")).alias("payload_sample_id"))


_SHARDS = """shards as (select case when n % 7 = 0 then 'scene-unknown' else scene_id end as scene_id, sample_id, case when n % 5 = 0 then 'scene-0' when n % 7 = 0 then 'scene-unknown' else scene_id end as payload_scene_id,
  case when n % 11 = 0 then 'sample-0' else sample_id end as payload_sample_id from (select distinct scene_id, sample_id, cast(split_part(sample_id, '-', 2) as bigint) as n from predictions))"""


def _gt_index(spark, d):
    return view(spark, d, "annotations").groupBy("scene_id").agg((F.count_if(F.col("category") == "c1") % 3 != 0).alias("has_gt"))


_INDEX = "index as (select scene_id, count(case when category = 'c1' then 1 end) % 3 <> 0 as has_gt from annotations group by scene_id)"


def e2_eligibility(spark, d):
    return _judged(spark, d)


E2 = f"""with {ctes('annotations', 'predictions')}, {_SHARDS}, {_INDEX}, ss as (select distinct sample_id, scene_id from annotations),
j as (select s.*, case when i.has_gt = false then s.scene_id when s.payload_scene_id <> s.scene_id then s.payload_scene_id when i.has_gt is not null then s.scene_id else ss.scene_id end as eval_scene_id
  from shards s left join index i on i.scene_id = s.scene_id left join ss on ss.sample_id = s.payload_sample_id)
select j.*, case when i.has_gt is null then 'sample_not_found_in_scene_index' when not i.has_gt then 'scene_has_no_ground_truth' else 'eligible' end as eligibility from j left join index i on i.scene_id = j.eval_scene_id"""


def e3_shard_warnings(spark, d):
    return E.shard_warnings(_shards(spark, d))


E3 = f"""with {ctes('annotations', 'predictions')}, {_SHARDS} select sample_id, 'shard_sample_id_mismatch' as code, sample_id as shard_value, payload_sample_id as payload_value from shards where sample_id <> payload_sample_id
union all select sample_id, 'shard_scene_id_mismatch', scene_id, payload_scene_id from shards where scene_id <> payload_scene_id"""


def e4_supported(spark, d):
    return _gt(spark, d).select("annotation_id", "category")


def e5_evaluable(spark, d):
    return _good(spark, d).select("prediction_id", "category", "lifting_status")


def e6_matches(spark, d):
    return E.matches(_gt(spark, d), _good(spark, d), DISTANCE)


def _judged(spark, d):
    return E.eligibility(_shards(spark, d), _gt_index(spark, d), view(spark, d, "annotations").select("sample_id", "scene_id").distinct())


def _sample_metrics(spark, d):
    return E.center_distance(view(spark, d, "annotations"), view(spark, d, "predictions"), DISTANCE, CLASSES, _judged(spark, d))


def e7_sample_metrics(spark, d):
    return _sample_metrics(spark, d)


_PREDICTED = f"""with recursive {_BOXES}, {_cells('sample_id')},
samples as (select s.sample_id, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(distance_sum, 0.0) as distance_sum from (select distinct sample_id from predictions) s left join c using (sample_id))"""
_PARTS, _, _STATE = E2.partition(f"{_INDEX},")[2].rpartition("\nselect j.*")
_SAMPLE = f"""{_PREDICTED.rpartition("samples as")[0]}{_SHARDS}, {_INDEX}, {_PARTS}, judged as (select j.*{_STATE}),
samples as (select s.sample_id, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(distance_sum, 0.0) as distance_sum from (select distinct payload_sample_id as sample_id from judged where eligibility = 'eligible') s left join c using (sample_id))"""


def e12_evaluator(spark, d):
    return E.get_evaluator("center_distance")(view(spark, d, "annotations"), view(spark, d, "predictions"), DISTANCE, CLASSES)


def e8_class_metrics(spark, d):
    gt, good = _gt(spark, d), _good(spark, d)
    return E.with_rates(E.counts(gt, good, E.matches(gt, good, DISTANCE), ["category"]))


def e9_run_totals(spark, d):
    return E.run_totals(_sample_metrics(spark, d))


E9 = f"""{_SAMPLE}, t as (select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, sum(distance_sum) as distance_sum, count(*) as evaluated_samples from samples)
select *, tp + fp as evaluable_predictions, tp + fn as ground_truth, {_RATES} from t"""


def e10_run_status(spark, d):
    index = _gt_index(spark, d)
    judged = E.eligibility(_shards(spark, d), index, view(spark, d, "annotations").select("sample_id", "scene_id").distinct())
    none = E.run_status(index.where("not has_gt"), judged, "skip").withColumn("case", F.lit("without ground truth"))
    return E.run_status(index, judged).withColumn("case", F.lit("whole")).union(none).union(E.run_status(index, judged.where("eligibility <> 'eligible'"), "fail").withColumn("case", F.lit("nothing eligible")))


E10 = f"""{E2.replace("select j.*, case", ", j2 as (select j.*, case", 1)}),
n as (select (select count(*) from index where has_gt) as gt, (select count(*) from j2 where eligibility = 'eligible') as ok),
s as (select case when gt = 0 then 'no_ground_truth_in_dataset' when ok = 0 then 'no_evaluable_samples' end as reason, 'skipped' as bad, 'whole' as "case" from n
  union all select 'no_ground_truth_in_dataset', 'skipped', 'without ground truth' union all select case when gt = 0 then 'no_ground_truth_in_dataset' else 'no_evaluable_samples' end, 'failed', 'nothing eligible' from n)
select case when reason is null then 'succeeded' else bad end as status, reason, "case" from s"""


def e11_run_record(spark, d):
    out = E.run_record(_sample_metrics(spark, d), _judged(spark, d), 3)
    return out.withColumn("evaluated_scene_ids", F.array_join("evaluated_scene_ids", ",")).withColumn("skipped_scene_ids", F.array_join("skipped_scene_ids", ","))


E11 = f"""{_SAMPLE}, t as (select sum(tp) as tp, sum(fp) as fp from samples), st as (select coalesce(eval_scene_id, scene_id) as scene_id, bool_or(eligibility = 'eligible') as evaluated from judged group by 1),
ids as (select evaluated, scene_id, row_number() over (partition by evaluated order by scene_id) as rn from st)
select 'precision' as primary_metric, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as primary_value, (select count(*) from st where evaluated) as evaluated_scene_count,
  coalesce((select string_agg(scene_id, ',' order by scene_id) from ids where evaluated and rn <= 3), '') as evaluated_scene_ids, (select count(*) from st where not evaluated) as skipped_scene_count,
  coalesce((select string_agg(scene_id, ',' order by scene_id) from ids where not evaluated and rn <= 3), '') as skipped_scene_ids from t"""


def e13_metric_catalogue(spark, d):
    runs = view(spark, d, "evaluation_runs").select("run_id", F.lit("detection").alias("task"), F.explode(F.create_map(F.lit("precision"), F.col("precision_value"), F.lit("false_positives"), F.col("sample_count").cast("double"))).alias("metric", "value"))
    return runs.join(F.broadcast(E.metric_specs(spark)), ["task", "metric"]).select("run_id", "metric", "value", "direction")


E13 = f"""with {ctes('evaluation_runs')} select run_id, 'precision' as metric, precision_value as value, 'higher' as direction from evaluation_runs union all select run_id, 'false_positives', sample_count::double, 'lower' from evaluation_runs"""


def x2_scene_comparison(spark, d):
    a = view(spark, d, "annotations")
    moved = a.withColumn("x", F.col("x") + 0.01 * (F.col("gt_pos") % 40)).where("gt_pos % 6 <> 0")
    return E.compare_scenes(a, moved, DISTANCE)


_MOVED = _BOXES.replace("gt as (select * from annotations where category in ('c1', 'c2', 'c3'))", "gt as (select * from annotations)").replace(
    "good as (select * from predictions where coalesce(lifting_status, '') <> 'failed')",
    "good as (select annotation_id as prediction_id, scene_id, sample_id, category, x + 0.01::double * (gt_pos % 40) as x, y, z, gt_pos as pred_pos from annotations where gt_pos % 6 <> 0)",
)
X2 = f"""with recursive {_MOVED}, m as (select scene_id, count(*) as tp from matched join gt using (annotation_id) group by scene_id), g as (select scene_id, count(*) as n from gt group by scene_id), p as (select scene_id, count(*) as n from good group by scene_id),
e as (select g.scene_id, round(avg(sqrt((g.x-p.x)*(g.x-p.x) + (g.y-p.y)*(g.y-p.y) + (g.z-p.z)*(g.z-p.z))), 6) as geometry_error from gt g join good p on p.prediction_id = g.annotation_id group by g.scene_id)
select scene_id, round(coalesce(2.0::double * coalesce(tp, 0) / nullif(coalesce(g.n, 0) + coalesce(p.n, 0), 0), 0), 6) as annotation_f1, geometry_error from g full join p using (scene_id) left join m using (scene_id) left join e using (scene_id)"""


TOLERANCE_US = 7 * 86_400_000_000
_AGENTS = """select user_id as scene_id, event_type as agent_id, US(ts) as timestamp_us, event_id as pos, value as x, cast(event_id % 7 as double) as y, 0.0 as z from events"""


def x2_trajectory_error(spark, d):
    """Users are scenes and kinds of events agents; the right side lacks every third place, and is later and moved."""
    events = table(spark, d, "events").withColumn("timestamp_us", F.expr("unix_micros(cast(ts as timestamp))"))
    left = events.select(F.col("user_id").alias("scene_id"), F.col("event_type").alias("agent_id"), "timestamp_us", F.col("event_id").alias("pos"), F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"))
    right = left.where("pos % 3 <> 0").withColumn("timestamp_us", F.col("timestamp_us") + 1000 * (F.col("pos") % 11)).withColumn("x", F.col("x") + 0.5)
    return E.trajectory_errors(left, right, TOLERANCE_US, 4 * TOLERANCE_US)


X2_TRAJECTORY = f"""with l as ({_AGENTS.replace("US(ts)", "epoch_us(ts)").replace("0.0 as z", "0.0::double as z")}), r as (select scene_id, agent_id, timestamp_us + 1000 * (pos % 11) as t, pos, x + 0.5::double as x, y from l where pos % 3 <> 0),
m as (select l.scene_id, l.agent_id, l.x, l.y, r.x as rx, r.y as ry, row_number() over (partition by l.pos order by abs(r.t - l.timestamp_us), r.t, r.pos) as rn from l join r on l.scene_id = r.scene_id and l.agent_id = r.agent_id and abs(r.t - l.timestamp_us) <= {TOLERANCE_US}),
a as (select scene_id, agent_id, avg(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))) as e from m where rn = 1 group by all), e as (select scene_id, round(avg(e), 6) as trajectory_error, count(*) as compared_agents from a group by scene_id)
select s.scene_id, trajectory_error, coalesce(compared_agents, 0) as compared_agents from (select distinct scene_id from l) s left join e using (scene_id)"""


def x2_sensor_coverage(spark, d):
    """The right side has only frames of a known width."""
    frames = view(spark, d, "sample_frames")
    return E.sensor_coverage(frames, frames.where("width is not null"))


X2_COVERAGE = f"""with {ctes('sample_frames')}, f as (select scene_id, channel, sample_id, max(case when width is not null then 1 else 0 end) as b from sample_frames group by all),
c as (select scene_id, channel, max(b) as b, count(*) as n, sum(b) as nb from f group by all)
select scene_id, round(sum(b) / count(*)::double, 6) as channel_coverage, round(sum(nb) / sum(n)::double, 6) as frame_coverage from c group by scene_id"""


def x6_label_quality(spark, d):
    return E.label_quality(view(spark, d, "annotations"), view(spark, d, "predictions"), DISTANCE)


_ALL = _BOXES.replace("gt as (select * from annotations where category in ('c1', 'c2', 'c3'))", "gt as (select * from annotations)")
X6 = f"""with recursive {_ALL}, t as (select (select count(*) from matched) as tp, (select count(*) from good) - (select count(*) from matched) as fp, (select count(*) from gt) - (select count(*) from matched) as fn, 0.0 as distance_sum),
r as (select {_RATES} from t) select precision, recall, coalesce(round(2 * precision * recall / nullif(precision + recall, 0), 6), 0) as f1,
round((select count(distinct sample_id) from good) / (select count(distinct sample_id) from (select sample_id from annotations union all select sample_id from predictions))::double, 6) as labeling_coverage from r"""


def o8_compare(spark, d, most=None):
    selection = _selection(spark, d, most).select("scene_id", "selected", "reason")
    evaluated = view(spark, d, "scenes").where("frame_count % 3 = 1").select("scene_id")
    return L.compare_runs(selection, evaluated)


O8 = f"""{_SELECTED}, e as (select scene_id from scenes where frame_count % 3 = 1)
select coalesce(s.scene_id, e.scene_id) as scene_id, coalesce(selected, false) as selected, e.scene_id is not null as evaluated, case when e.scene_id is null then coalesce(reason, 'eval_skipped') end as skip_reason from selection s full join e on s.scene_id = e.scene_id"""

QUERIES = {
    "s5_first_samples": (s5_first_samples, S5),
    "d1_scene_selection": (d1_scene_selection, f"{_SELECTED} select scene_id, selected, reason from selection"),
    "d2_selection_summary": (d2_selection_summary, D2),
    "d3_samples": (d3_samples, D3),
    "d7_prediction_counters": (d7_prediction_counters, D7),
    "d14_run_rollup": (d14_run_rollup, D14),
    "d15_admission_errors": (d15_admission_errors, D15),
    "e1_scene_index": (e1_scene_index, E1),
    "e2_eligibility": (e2_eligibility, E2),
    "e3_shard_warnings": (e3_shard_warnings, E3),
    "e4_supported": (e4_supported, f"with {ctes('annotations')} select annotation_id, category from annotations where category in ('c1', 'c2', 'c3')"),
    "e5_evaluable": (e5_evaluable, f"with {ctes('predictions')} select prediction_id, category, lifting_status from predictions where coalesce(lifting_status, '') <> 'failed'"),
    "e6_matches": (e6_matches, f"with recursive {_BOXES} select * from matched"),
    "e7_sample_metrics": (e7_sample_metrics, f"{_SAMPLE} select *, {_RATES} from samples"),
    "e8_class_metrics": (e8_class_metrics, f"with recursive {_BOXES}, {_cells('category')} select *, {_RATES} from c"),
    "e9_run_totals": (e9_run_totals, E9),
    "e10_run_status": (e10_run_status, E10),
    "e11_run_record": (e11_run_record, E11),
    "e12_evaluator": (e12_evaluator, f"{_PREDICTED} select *, {_RATES} from samples"),
    "e13_metric_catalogue": (e13_metric_catalogue, E13),
    "o8_compare": (o8_compare, O8),
    "x2_scene_comparison": (x2_scene_comparison, X2),
    "x2_sensor_coverage": (x2_sensor_coverage, X2_COVERAGE),
    "x2_trajectory_error": (x2_trajectory_error, X2_TRAJECTORY),
    "x6_label_quality": (x6_label_quality, X6),
}
# Where the cap is what is asked for.
for _name, _capped in (("d1_scene_selection", "d1_capped_selection"), ("d2_selection_summary", "d2_capped_summary"), ("o8_compare", "o8_capped_compare")):
    _query, _twin = QUERIES[_name]
    QUERIES[_capped] = (partial(_query, most=1000), _twin.replace("annotation_count from n)", "annotation_count from n where before < 1000)"))
QUERIES["d3_capped_samples"] = (partial(d3_samples, most=3000), f"{D3} limit 3000")
