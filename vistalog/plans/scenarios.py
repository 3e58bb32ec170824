"""Queries over scenarios, leaderboards, operations and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import diverse as V
from ..operators import exports as X
from ..operators import predicates as P
from ..operators import scenario as M
from ..operators import views as L
from ..operators.steps import folder, written
from .adapters import ctes, table, view

CHANNELS = ("CAM_FRONT", "LIDAR_TOP")
FILTERS = {"profile": "detection_ready", "min_annotation_count": 2, "required_channels": CHANNELS}


def _candidates(spark, d):
    channels = view(spark, d, "scene_channels").groupBy("scene_id").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    return M.with_candidate_columns(view(spark, d, "scenes").join(channels, "scene_id", "left").withColumn("channels", F.coalesce("channels", F.array().cast("array<string>"))))


_CANDIDATES = f"""with {ctes('scenes', 'scene_channels')}, ch as (select scene_id, list(channel) as channels from scene_channels group by scene_id),
c as (select s.*, coalesce(channels, []) as channels, has_ground_truth and annotation_count > 0 as selectable, case when status in ('validated', 'profiled') then 'ready' when status = 'failed' then 'blocked' else 'unknown' end as validation_status from scenes s left join ch using (scene_id)),
r as (select *, concat_ws(',', case when not has_ground_truth then 'gt_mismatch' end, case when annotation_count < 2 then 'annotation_count_below_min' end, case when status not in ('validated', 'profiled') then 'not_validated' end,
  case when not (list_contains(channels, 'CAM_FRONT') and list_contains(channels, 'LIDAR_TOP')) then 'missing_channels:' || concat_ws(',', case when not list_contains(channels, 'CAM_FRONT') then 'CAM_FRONT' end, case when not list_contains(channels, 'LIDAR_TOP') then 'LIDAR_TOP' end) end) as reasons from c)"""


def m1_filter_reasons(spark, d):
    return _candidates(spark, d).select("scene_id", F.array_join(M.filter_reasons(**FILTERS), ",").alias("reasons"))


def m1_rejected(spark, d):
    return M.rejected(_candidates(spark, d), **FILTERS).select("scene_id", F.array_join("reasons", ",").alias("reasons"))


def m2_candidate_columns(spark, d):
    return _candidates(spark, d).select("scene_id", "selectable", "validation_status")


def m3_sorted_candidates(spark, d):
    return M.mine(_candidates(spark, d), "sample_count", "asc", 200, profile="no_gt_candidates").select("scene_id", "sample_count", "created_us")


def _mined(spark, d):
    return M.mine(_candidates(spark, d), max_candidates=500, **FILTERS)


def m4_candidates(spark, d):
    return _mined(spark, d).select("scene_id", "annotation_count", "created_us")


_MINED = f"{_CANDIDATES}, mined as (select * from r where reasons = '' order by annotation_count desc, created_us desc, scene_id limit 500)"


def _scored(spark, d):
    return M.score(_candidates(spark, d).withColumn("candidate_pos", F.col("scene_id").cast("long")), ["CAM_FRONT", "RADAR_FRONT"])


def m5_scores(spark, d):
    return _scored(spark, d).select("scene_id", "score", F.array_join("reasons", ",").alias("reasons"))


_SCORED = f"""{_CANDIDATES}, p as (select *, case when selectable then 0.30::double else 0.0::double end as gt, case when validation_status = 'ready' then 0.25::double when validation_status = 'warning' then 0.15::double else 0.0::double end as v,
  case when list_contains(channels, 'CAM_FRONT') and list_contains(channels, 'RADAR_FRONT') then 0.20::double when list_contains(channels, 'CAM_FRONT') or list_contains(channels, 'RADAR_FRONT') then 0.10::double else 0.0::double end as ch,
  round(least(0.15::double, 0.15::double * annotation_count / (max(annotation_count) over ())), 4) as dn, case when sample_count > 0 and frame_count > 0 then 0.10::double else 0.0::double end as wh from c),
scored as (select *, round(gt + v + ch + dn + wh, 4) as score, concat_ws(',', case when gt > 0 then 'has_ground_truth' end, case when v > 0 then 'validation_' || validation_status end, case when ch = 0.20::double then 'required_channels_present' when ch > 0 then 'partial_channels_present' end,
  case when annotation_count > 0 then 'dense_annotations' end, case when wh > 0 then 'complete_sequence' end) as reasons from p),
bucketed as (select *, case when score >= 0.75 then 'ready' when score >= 0.40 then 'warning' else 'blocked' end as bucket from scored)"""


def m6_buckets(spark, d):
    return _scored(spark, d).groupBy("dataset_id", "bucket").agg(F.count("*").alias("scenes"))


def m7_score_rollup(spark, d):
    return M.score_rollup(_scored(spark, d)).withColumn("top_scene_ids", F.array_join("top_scene_ids", ","))


M7 = f"""{_SCORED} select count(*) as scored_count, count(case when bucket = 'ready' then 1 end) as ready_count, count(case when bucket = 'warning' then 1 end) as warning_count, count(case when bucket = 'blocked' then 1 end) as blocked_count, round(avg(score), 4) as average_score,
(select string_agg(scene_id, ',' order by score desc, cast(scene_id as bigint)) from (select scene_id, score from bucketed where bucket = 'ready' order by score desc, cast(scene_id as bigint) limit 5)) as top_scene_ids from bucketed"""


def _runs(spark, d):
    r = view(spark, d, "evaluation_runs")
    return r.select("run_id", "model_id", "created_us", F.when(F.col("sample_count") % 5 != 0, F.round("precision_value", 6)).alias("metric"), F.when(F.col("sample_count") % 4 != 0, (F.col("sample_count") / 1000).cast("string")).alias("summary_metric"))


_RUNS = f"""with {ctes('evaluation_runs')}, runs as (select run_id, model_id, created_us, case when sample_count % 5 <> 0 then round(precision_value, 6) end as metric, case when sample_count % 4 <> 0 then sample_count / 1000::double end as summary_metric from evaluation_runs),
v as (select *, coalesce(nullif(metric, 0.0), summary_metric) as value from runs)"""


def l1_leaderboard(spark, d):
    return L.leaderboard(_runs(spark, d), "desc", 50, 10).select("run_id", "value", "rank")


L1 = f"""{_RUNS}, page as (select * from v order by created_us desc, run_id limit 50 offset 10) select run_id, value, row_number() over (order by value desc nulls last, created_us desc, run_id) as rank from page"""


def l1_global_rank(spark, d):
    return L.leaderboard(_runs(spark, d), "asc", global_rank=True).select("run_id", "value", "rank")


def l2_model_history(spark, d):
    return C.listing(_runs(spark, d), {"model_id": "m3"}, id_column="run_id", limit=20).select("run_id", "created_us")


def _jobs(spark, d):
    return view(spark, d, "jobs")


def o1_status_counts(spark, d):
    return L.status_counts(_jobs(spark, d))


O1 = f"""with {ctes('jobs')} select kind, count(case when status = 'running' then 1 end) as running, count(case when status = 'failed' then 1 end) as failed, count(case when status = 'succeeded' then 1 end) as succeeded,
case when kind = 'execution' then 0 else count(case when status = 'pending' then 1 end) end as pending from jobs group by kind"""


def o2_timeline(spark, d):
    return L.newest(_jobs(spark, d), ["job", "pipeline_run"], 50).select("kind", "job_id", "created_us")


O2 = f"with {ctes('jobs')} select kind, job_id, created_us from jobs where kind in ('job', 'pipeline_run') order by created_us desc, job_id limit 50"


def o3_failures(spark, d):
    return L.newest(_jobs(spark, d), L.KINDS, 50, 5, "failed").select("kind", "job_id", "created_us", "error_json")


O3 = f"with {ctes('jobs')}, n as (select *, row_number() over (partition by kind order by created_us desc, job_id) as rn from jobs where status = 'failed') select kind, job_id, created_us, error_json from n where rn > 5 and rn <= 55 order by created_us desc, job_id limit 50"


def o4_recent(spark, d):
    return L.newest(_jobs(spark, d), ["execution"], 30).select("job_id", "status", "created_us")


def o5_event_log(spark, d):
    return L.event_log(_jobs(spark, d).withColumnRenamed("status", "level"), "failed", 200, 20).select("job_id", "created_us")


SPECS = [("job", "metrics", "key", "k", None, True), ("job", "refs", "missing", "no.such", "none", False), ("pipeline_run", "metrics", "key", "k", None, True), ("pipeline_run", "summary", "other", "no", None, True)]


def _values(spark, d):
    specs = spark.createDataFrame(SPECS, "task_type string, bucket string, key string, path string, default_value string, required boolean")
    results = _jobs(spark, d).select(F.concat(F.lit("run-"), (F.col("job_id").cast("long") % 700).cast("string")).alias("run_id"), F.col("job_id").alias("task_id"), F.col("created_us").alias("task_order"), F.col("kind").alias("task_type"), F.col("error_json").alias("raw"))
    return L.extracted(results, F.broadcast(specs))


def o6_extracted(spark, d):
    return _values(spark, d)


_VALUES = f"""with {ctes('jobs')}, specs as (select * from (values ('job', 'metrics', 'key', 'k', null, true), ('job', 'refs', 'missing', 'no.such', 'none', false), ('pipeline_run', 'metrics', 'key', 'k', null, true), ('pipeline_run', 'summary', 'other', 'no', null, true)) s(task_type, bucket, key, path, default_value, required)),
x as (select 'run-' || cast(cast(job_id as bigint) % 700 as varchar) as run_id, job_id as task_id, created_us as task_order, bucket, key, coalesce(json_extract_string(error_json, '$.' || path), default_value) as value, required from jobs join specs on task_type = kind),
vals as (select run_id, task_id, task_order, bucket, key, value, value is null and required as missing from x)"""


def o7_run_results(spark, d):
    return L.run_results(_values(spark, d))


O7 = f"{_VALUES} select run_id, bucket, key, value from (select *, row_number() over (partition by run_id, bucket, key order by task_order desc, task_id desc) as rn from vals where value is not null) where rn = 1"


def o9_lineage(spark, d):
    artifacts = view(spark, d, "scene_runs").select(F.concat(F.lit("art-"), "run_id").alias("artifact_id"), F.concat(F.substring_index(F.substring_index("run_id", "-", 3), "-", -1), F.lit("-"), F.lit("O")).alias("run_id"), "type", "created_us")
    runs = view(spark, d, "evaluation_runs").select("run_id", "model_id")
    return C.lineage(artifacts, runs).select("artifact_id", "run_id", "type", "created_us", "model_id")


O9 = f"""with {ctes('scene_runs', 'evaluation_runs')}, a as (select 'art-' || run_id as artifact_id, split_part(run_id, '-', 3) || '-O' as run_id, type, created_us from scene_runs)
select artifact_id, a.run_id, type, a.created_us, model_id from a left join evaluation_runs using (run_id)"""


def x1_distribution(spark, d):
    scenes = view(spark, d, "scenes").join(view(spark, d, "scene_channels"), "scene_id")
    return L.distribution(scenes.where("dataset_id = 'ds-1'"), scenes.where("dataset_id = 'ds-2' and channel <> 'RADAR_FRONT'"), "channel")


X1 = f"""with {ctes('scenes', 'scene_channels')}, s as (select dataset_id, channel from scenes join scene_channels using (scene_id)), a as (select channel, count(*) / sum(count(*)) over ()::double as left_share from s where dataset_id = 'ds-1' group by channel),
b as (select channel, count(*) / sum(count(*)) over ()::double as right_share from s where dataset_id = 'ds-2' and channel <> 'RADAR_FRONT' group by channel), j as (select channel, coalesce(left_share, 0) as left_share, coalesce(right_share, 0) as right_share from a full join b using (channel))
select *, right_share - left_share as difference, abs(right_share - left_share) as l1, round((greatest(right_share, 1e-6) - greatest(left_share, 1e-6)) * ln(greatest(right_share, 1e-6) / greatest(left_share, 1e-6)), 9) as psi from j"""


def x1_distribution_sets(spark, d):
    rows = view(spark, d, "scenes").join(view(spark, d, "scene_channels"), "scene_id").withColumn("size_class", F.least("sample_count", F.lit(4)))
    left, right = rows.where("dataset_id = 'ds-1'"), rows.where("dataset_id = 'ds-2' and channel <> 'RADAR_FRONT'")
    return L.distribution_sets(left, right, [["channel"], ["size_class"], ["channel", "size_class"]])


X1S = f"""with {ctes('scenes', 'scene_channels')}, s as (select dataset_id, channel, least(sample_count, 4) as size_class from scenes join scene_channels using (scene_id) where dataset_id = 'ds-1' or dataset_id = 'ds-2' and channel <> 'RADAR_FRONT'),
g as (select channel, size_class, grouping(channel, size_class) as k, count(*) filter (dataset_id = 'ds-1') as a, count(*) filter (dataset_id = 'ds-2') as b from s group by grouping sets ((), (channel), (size_class), (channel, size_class))),
t as (select a as total_left, b as total_right from g where k = 3),
h as (select case k when 1 then 'channel' when 2 then 'size_class' else 'channel+size_class' end as compared, channel, size_class, total_left, total_right, a / total_left::double as left_share, b / total_right::double as right_share from g, t where k <> 3)
select *, right_share - left_share as difference, abs(right_share - left_share) as l1, round((greatest(right_share, 1e-6) - greatest(left_share, 1e-6)) * ln(greatest(right_share, 1e-6) / greatest(left_share, 1e-6)), 9) as psi from h"""


def x3_predicates(spark, d):
    c = _candidates(spark, d).withColumn("end_us", F.col("created_us") + 10)
    c = c.withColumn("start_us", F.col("created_us"))
    both = M.predicate("channel", values=["CAM_FRONT"]) & M.predicate("object_count", min=2, max=4) & M.predicate("expression", sql="sample_count > 2") & M.predicate("time_range", start_us=820454400000000, end_us=946684800000000)
    return c.where(both).select("scene_id", "annotation_count")


X3 = f"{_CANDIDATES} select scene_id, annotation_count from c where list_contains(channels, 'CAM_FRONT') and annotation_count between 2 and 4 and sample_count > 2 and created_us + 10 >= 820454400000000 and created_us <= 946684800000000"


def x3_ego_speed(spark, d):
    return M.ego_speed(view(spark, d, "ego_poses").withColumn("scene_id", (F.col("pos") % 50).cast("string"))).withColumn("max_speed", F.round("max_speed", 6))


X3S = f"""with {ctes('ego_poses')}, p as (select *, cast(pos % 50 as varchar) as scene_id from ego_poses), s as (select scene_id, abs(x - lag(x) over w) * 1000000 / nullif(timestamp_us - lag(timestamp_us) over w, 0) as v from p window w as (partition by scene_id order by timestamp_us, pos))
select scene_id, round(max(v), 6) as max_speed from s group by scene_id"""


def x3_definitions(spark, d):
    """Definitions from a table: a row of each region asks for another number of boxes, of samples and of channels."""
    k = F.col("r_regionkey")
    one = lambda name, kind, params, weight, enabled: F.struct(F.lit(name).alias("predicate_id"), F.lit(kind).alias("type"), params.alias("params"), weight.cast("double").alias("weight"), enabled.alias("enabled"))
    each = F.array(
        one("boxes", "object_count", F.to_json(F.struct(F.lit("vehicle.car").alias("category"), k.alias("min_count"))), F.lit(2), F.lit(True)),
        one("few", "object_count", F.to_json(F.struct((k + 3).alias("max_count"))), F.lit(1), k != 2),
        one("front", "sensor_channel", F.to_json(F.struct(F.array(F.lit("CAM_FRONT")).alias("required_channels"))), F.lit(1), F.lit(True)),
        one("samples", "custom", F.to_json(F.struct(F.concat(F.lit("sample_count > "), k.cast("string")).alias("expression"))), k, F.lit(True)),
    )
    rows = table(spark, d, "region").select(F.concat(F.lit("def-"), k.cast("string")).alias("definition_id"), F.inline(each))
    scenes = _candidates(spark, d)
    out = P.evaluate(scenes, view(spark, d, "annotations"), P.from_rows(rows), ["sample_count", "annotation_count"])
    return out.select("definition_id", "scene_id", F.array_join("matched", ",").alias("matched"), F.array_join("failed", ",").alias("failed"), F.round("score", 6).alias("score"), "passes")


X3D = f"""{_CANDIDATES.replace("with ", "with " + ctes("annotations").strip() + ", ", 1)}, boxes as (select scene_id, count(*) filter (category = 'vehicle.car') as cars from annotations group by scene_id),
e as (select r_regionkey as k, scene_id, [coalesce(coalesce(cars, 0) >= r_regionkey, false), coalesce(annotation_count <= r_regionkey + 3, false), coalesce(list_contains(channels, 'CAM_FRONT'), false), coalesce(sample_count > r_regionkey, false)] as h from c left join boxes using (scene_id), region),
p as (select k, scene_id, unnest(['boxes', 'few', 'front', 'samples']) as id, unnest(h) as holds, unnest([2.0::double, 1.0::double, 1.0::double, k::double]) as w from e)
select 'def-' || k as definition_id, scene_id, coalesce(string_agg(id, ',' order by id) filter (holds), '') as matched, coalesce(string_agg(id, ',' order by id) filter (not holds), '') as failed,
round(coalesce(sum(w) filter (holds), 0) / sum(w), 6) as score, bool_and(holds) as passes from p where k <> 2 or id <> 'few' group by k, scene_id"""


def x4_strategies(spark, d):
    # Four strategies read the scored scenes, which are made once.
    s = written(_scored(spark, d).select("scene_id", "score", "dataset_id"), "scored")
    tag = lambda df, name: df.select("scene_id", F.lit(name).alias("strategy"))
    out = tag(M.choose(s, "top_k", {"k": 100}), "top_k").union(tag(M.choose(s, "threshold", {"least": 0.8}), "threshold"))
    return out.union(tag(M.choose(s, "balanced", {"by": "dataset_id", "per_value": 20}), "balanced")).union(tag(M.choose(s, "diversity", {"by": "dataset_id", "k": 33}), "diversity"))


X4 = f"""{_SCORED}, n as (select scene_id, score, row_number() over (partition by dataset_id order by score desc, scene_id) as rn from bucketed)
select * from (select scene_id, 'top_k' as strategy from n order by score desc, scene_id limit 100) union all select scene_id, 'threshold' from n where score >= 0.8 union all select scene_id, 'balanced' from n where rn <= 20
union all select * from (select scene_id, 'diversity' from n order by rn, score desc, scene_id limit 33)"""


def x5_split(spark, d):
    return L.split(view(spark, d, "scenes"), "scene_id").groupBy("dataset_id", "split").agg(F.count("*").alias("scenes"))


X5 = f"""with {ctes('scenes')}, s as (select dataset_id, cast('0x' || substr(sha256(scene_id), 1, 8) as bigint) % 100 as slot from scenes)
select dataset_id, case when slot < 80 then 'train' when slot < 90 then 'val' else 'test' end as split, count(*) as scenes from s group by all"""


def x4_balanced_keys(spark, d):
    """A report of 300 scenes with quotas over dataset and status, twice the share for validated ones."""
    s = _scored(spark, d).select("scene_id", "score", "dataset_id", "status")
    return V.balanced(s, 300, ["dataset_id", "status"], F.when(F.col("status") == "validated", 2.0).otherwise(1.0))


X4B = f"""{_SCORED}, n as (select scene_id, score, dataset_id, status, case when status = 'validated' then 2.0::double else 1.0::double end as w, row_number() over (partition by dataset_id, status order by score desc, scene_id) as rn from bucketed)
select scene_id, score, dataset_id, status, row_number() over (order by (2 * rn - 1) / w, score desc, scene_id) as chosen_rank from n order by chosen_rank limit 300"""


_DAY = 86_400_000_000


def x4_k_centres(spark, d):
    """24 scenes that lie far apart in size, age, dataset and status."""
    s = _scored(spark, d).withColumn("age", F.floor(F.col("created_us") / _DAY)).select("scene_id", "score", "annotation_count", "sample_count", "age", "dataset_id", "status")
    out = V.k_centres(s, 24, {"annotation_count": 1.0, "sample_count": 1.0, "age": 0.0078125}, ["dataset_id", "status"])
    return out.select("scene_id", "chosen_rank", F.round("distance", 6).alias("distance"))


X4K = f"""{_SCORED.replace("with ", "with recursive ", 1)}, f as (select scene_id, score, annotation_count::double as a, sample_count::double as b, floor(created_us / {_DAY}::double) * 0.0078125::double as c, dataset_id as d, status as e from bucketed),
g as (select 1 as step, *, null::double as dist, row_number() over (order by score desc, scene_id) = 1 as picked from f
union all select step + 1, scene_id, score, a, b, c, d, e, dn, row_number() over (order by dn desc, score desc, scene_id) = 1 from (
  select g.* exclude (dist, picked), least(coalesce(g.dist, 1e300::double), (g.a - p.a) ** 2 + (g.b - p.b) ** 2 + (g.c - p.c) ** 2 + (g.d <> p.d)::int + (g.e <> p.e)::int) as dn
  from g, (select * from g where picked) p where not g.picked) where step < 24)
select scene_id, step::bigint as chosen_rank, round(dist, 6) as distance from g where picked"""


def _split_scenes(spark, d):
    customers = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("scene_id"), F.col("o_custkey").alias("site"))
    scenes = view(spark, d, "scenes").join(customers, "scene_id")
    return X.stratified_split(scenes, "site", ["dataset_id", "has_ground_truth"])


_SPLIT = f"""with {ctes('scenes')}, s as (select s.*, o.o_custkey as site from scenes s join orders o on s.scene_id = cast(o.o_orderkey as varchar)),
c as (select site, dataset_id, has_ground_truth, count(*) as c from s group by all),
h as (select site, sum(c)::bigint as n, arg_min(dataset_id, (-c, dataset_id, has_ground_truth)) as ds, arg_min(has_ground_truth, (-c, dataset_id, has_ground_truth)) as gt from c group by site),
m as (select *, 2 * sum(n) over (partition by ds, gt order by sha256(':' || site), site rows unbounded preceding) - n as mid, sum(n) over (partition by ds, gt) as total from h),
k as (select site, case when mid * 50 < total * 80 then 'train' when mid * 50 < total * 90 then 'val' else 'test' end as split from m),
x as (select s.*, split from s join k using (site))"""


def x5_stratified_split(spark, d):
    return _split_scenes(spark, d).select("scene_id", "site", "split")


def x5_export(spark, d):
    """Scenes and their channels, written by split and shard, and the index read again."""
    index = X.export(_split_scenes(spark, d), {"scene_channels": view(spark, d, "scene_channels"), "scene_runs": view(spark, d, "scene_runs")}, folder(spark, "export"), rows_per_shard=500)
    return index.groupBy("table", "split").agg(F.count("*").alias("shards"), F.sum("row_count").alias("row_count"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


X5E = f"""{_SPLIT.replace(ctes('scenes'), ctes('scenes', 'scene_channels', 'scene_runs'))}, z as (select split, ceil(count(*) / 500.0)::bigint as shards from x group by split),
t as (select 'scenes' as "table", split, scene_id from x union all select 'scene_channels', split, scene_id from x join scene_channels using (scene_id) union all select 'scene_runs', split, scene_id from x join scene_runs using (scene_id))
select "table", split, any_value(shards) as shards, count(*) as row_count, min(scene_id) as first_key, max(scene_id) as last_key from t join z using (split) group by all"""

QUERIES = {
    "m1_filter_reasons": (m1_filter_reasons, f"{_CANDIDATES} select scene_id, reasons from r"),
    "m1_rejected": (m1_rejected, f"{_CANDIDATES} select scene_id, reasons from r where reasons <> ''"),
    "m2_candidate_columns": (m2_candidate_columns, f"{_CANDIDATES} select scene_id, selectable, validation_status from c"),
    "m3_sorted_candidates": (m3_sorted_candidates, f"{_CANDIDATES} select scene_id, sample_count, created_us from c where not has_ground_truth order by sample_count, created_us desc, scene_id limit 200"),
    "m4_candidates": (m4_candidates, f"{_MINED} select scene_id, annotation_count, created_us from mined"),
    "m5_scores": (m5_scores, f"{_SCORED} select scene_id, score, reasons from scored"),
    "m6_buckets": (m6_buckets, f"{_SCORED} select dataset_id, bucket, count(*) as scenes from bucketed group by all"),
    "m7_score_rollup": (m7_score_rollup, M7),
    "l1_leaderboard": (l1_leaderboard, L1),
    "l1_global_rank": (l1_global_rank, f"{_RUNS} select run_id, value, dense_rank() over (order by value asc nulls last) as rank from v"),
    "l2_model_history": (l2_model_history, f"{_RUNS} select run_id, created_us from runs where model_id = 'm3' order by created_us desc, run_id limit 20"),
    "o1_status_counts": (o1_status_counts, O1),
    "o2_timeline": (o2_timeline, O2),
    "o3_failures": (o3_failures, O3),
    "o4_recent": (o4_recent, f"with {ctes('jobs')} select job_id, status, created_us from jobs where kind = 'execution' order by created_us desc, job_id limit 30"),
    "o5_event_log": (o5_event_log, f"with {ctes('jobs')} select job_id, created_us from jobs where status = 'failed' order by created_us, job_id limit 200 offset 20"),
    "o6_extracted": (o6_extracted, f"{_VALUES} select * from vals"),
    "o7_run_results": (o7_run_results, O7),
    "o9_lineage": (o9_lineage, O9),
    "x1_distribution": (x1_distribution, X1),
    "x1_distribution_sets": (x1_distribution_sets, X1S),
    "x3_predicates": (x3_predicates, X3),
    "x3_definitions": (x3_definitions, X3D),
    "x3_ego_speed": (x3_ego_speed, X3S),
    "x4_strategies": (x4_strategies, X4),
    "x4_balanced_keys": (x4_balanced_keys, X4B),
    "x4_k_centres": (x4_k_centres, X4K),
    "x5_split": (x5_split, X5),
    "x5_stratified_split": (x5_stratified_split, f"{_SPLIT} select scene_id, site, split from x"),
    "x5_export": (x5_export, X5E),
}
