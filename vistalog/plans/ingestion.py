"""Queries over ingestion and lifting, on source-shaped views of the given tables."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import infer as N
from ..operators import ingest as I
from ..operators import lift as D
from ..sources.readers import sensor_uri
from .adapters import table

_SOURCE = {
    "src_scenes": "select distinct concat('u', cast(user_id as string)) as token, concat('scene-', cast(user_id as string)) as name from events",
    "src_samples": "select cast(event_id as string) as token, concat('u', cast(user_id as string)) as scene_token, US(ts) as timestamp_us from events where event_id % 2 = 0",
    "src_data": """select concat('d', cast(event_id as string)) as token, cast(event_id - event_id % 2 as string) as sample_token, US(ts) as timestamp_us,
        case event_type when 'view' then 'CAM_FRONT' when 'click' then 'LIDAR_TOP' when 'error' then 'RADAR_FRONT' else 'CAM_BACK' end as channel,
        concat('samples/', cast(event_id as string), '.bin') as filename, concat('cs', cast(event_id % 7 as string)) as calibrated_sensor_token, concat('p', cast(event_id as string)) as ego_pose_token,
        cast(event_id % 3 * 800 as int) as width, cast(event_id % 4 * 300 as int) as height, event_id as pos, concat('log', cast(user_id % 5 as string)) as raw_log_id, cast(user_id as string) as sequence_id from events""",
    "src_calibrations": "select distinct concat('cs', cast(event_id % 6 as string)) as token, concat('s', cast(event_id % 6 % 4 as string)) as sensor_token from events",
    "src_sensors": "select distinct concat('s', cast(event_id % 3 as string)) as token, case event_id % 3 when 0 then 'camera' when 1 then 'Lidar ' else 'sonar' end as modality from events",
    "src_poses": "select concat('p', cast(event_id as string)) as token, US(ts) as timestamp_us from events where event_id % 10 <> 9",
    "src_boxes": """select concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string)) as token, cast(l_partkey % 1000 * 2 as string) as sample_token,
        cast(l_orderkey as string) as instance_token, concat(l_returnflag, '.', l_linestatus) as category, US(l_shipdate) as timestamp_us, l_quantity as x, l_tax as y, l_discount as z,
        concat(l_returnflag, ',', l_linestatus, ',x') as attribute_list from lineitem""",
    "src_attributes": "select distinct l_returnflag as token, concat('name-', l_returnflag) as name from lineitem union select distinct l_linestatus, concat('name-', l_linestatus) from lineitem",
    "lidar_points": "select concat('f', cast(cast(floor(vec_id / 5.0) as bigint) as string)) as frame_id, vec_id * 21 + K as point_pos, EL3(1) as x, EL3(2) as y, EL3(3) as z from embeddings",
    "detections": """select concat('det-', cast(o_orderkey as string)) as detection_id, concat('sample-', cast(o_orderkey % 97 as string)) as sample_id, cast(cast(floor(o_orderkey / 97.0) as bigint) as int) as det_pos,
        concat('f', cast(o_orderkey % lidar_frames as string)) as lidar_frame_id, o_orderpriority as category, o_totalprice as score, cast(o_custkey % 40 as double) as x1, cast(o_custkey % 30 as double) as y1,
        cast(o_custkey % 40 + 60 as double) as x2, cast(o_custkey % 30 + 60 as double) as y2, case when o_orderkey % 13 = 0 then null else 1600 end as width, 900 as height, o_orderkey % 41 = 0 as lift_failed from orders cross join (select max(cast(floor(vec_id / 5.0) as bigint)) + 1 as lidar_frames from embeddings) n""",
}


def _sql(name: str, duck: bool) -> str:
    s = _SOURCE[name]
    s = re.sub(r"US\((\w+)\)", r"epoch_us(\1)" if duck else r"unix_micros(cast(\1 as timestamp))", s)
    if name == "lidar_points":
        s = re.sub(r"EL3\((\d)\)", (r"cast(list_extract(embedding, 3 * k + \1) as double)" if duck else r"cast(element_at(embedding, cast(3 * k + \1 as int)) as double)"), s).replace("+ K ", "+ k ")
        s += ", (select unnest(generate_series(0, 20)) as k)" if duck else " lateral view explode(sequence(0, 20)) t as k"
    return s


def _view(spark, d, name):
    sql = re.sub(r"\bfrom (events|lineitem|embeddings|orders)\b", r"from {\1}", _sql(name, False))
    return spark.sql(sql, **{t: table(spark, d, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def _with(*names):
    return "with " + ",\n".join(f"{n} as ({_sql(n, True)})" for n in names)


def _ordered(spark, d):
    return I.ordered_samples(_view(spark, d, "src_scenes"), _view(spark, d, "src_samples"))


_ORDERED = _with("src_scenes", "src_samples", "src_data", "src_calibrations", "src_sensors", "src_poses", "src_boxes", "src_attributes") + """,
n as (select s.*, c.name as scene_id, row_number() over (partition by scene_token order by timestamp_us, s.token) - 1 as frame_index from src_samples s join src_scenes c on c.token = s.scene_token),
ordered as (select *, scene_id || '-s' || lpad(cast(frame_index as varchar), 4, '0') as sample_id from n)"""


def i1_ordered_samples(spark, d):
    return _ordered(spark, d).select("token", "scene_id", "frame_index", "sample_id")


_LINK_ORDER = "case when user_id % 2 = 0 then event_id % 7 else 0 end, ts, event_id"


def i1_linked_samples(spark, d):
    """Links of every second scene leave time order."""
    events = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("user_id") % 2 == 0, F.col("event_id") % 7).otherwise(0), "ts", "event_id")
    text = lambda c: F.col(c).cast("string")
    linked = events.select("user_id", text("event_id").alias("token"), F.coalesce(F.lead(text("event_id")).over(w), F.lit("")).alias("next"), F.row_number().over(w).alias("_n"))
    linked = linked.withColumn("scene_token", F.concat(F.lit("u"), text("user_id")))
    first = linked.where("_n = 1").select("scene_token", F.col("token").alias("first_sample_token"))
    scenes = _view(spark, d, "src_scenes").join(first, F.col("token") == F.col("scene_token")).drop("scene_token")
    return I.linked_samples(scenes, linked.select("token", "scene_token", "next")).select("token", "scene_id", "frame_index", "sample_id")


I1_LINKED = f"""with n as (select cast(event_id as varchar) as token, 'scene-' || cast(user_id as varchar) as scene_id, row_number() over (partition by user_id order by {_LINK_ORDER}) - 1 as frame_index from events)
select *, scene_id || '-s' || lpad(cast(frame_index as varchar), 4, '0') as sample_id from n"""


def _boxes(spark, d):
    """Columns that order boxes of one token are in ``pos`` alone, so they are shuffled once."""
    boxes = _view(spark, d, "src_boxes").select("token", "instance_token", F.struct("sample_token", "category", "timestamp_us", "x", "y", "z", "attribute_list").alias("pos"))
    return I.registry(boxes, ["token"]).select("token", "instance_token", "pos.*").withColumn("attribute_tokens", F.split("attribute_list", ","))


_BOXES = "boxes as (select * exclude rn from (select *, row_number() over (partition by token order by sample_token desc, category desc, timestamp_us desc, x desc, y desc, z desc, attribute_list desc) as rn from src_boxes) where rn = 1)"


def _annotations(spark, d):
    lists = _view(spark, d, "src_boxes").select(F.split("attribute_list", ",").alias("attribute_tokens"))
    return I.annotations(_ordered(spark, d), _boxes(spark, d).drop("timestamp_us"), _view(spark, d, "src_attributes"), lists)


def i2_annotations(spark, d):
    out = _annotations(spark, d)
    return out.select("token", "scene_id", "sample_id", "category", F.array_join("attributes", ",").alias("attributes"))


I2 = f"""{_ORDERED}, {_BOXES} select b.token, scene_id, sample_id, category, 'name-' || split_part(attribute_list, ',', 1) || ',name-' || split_part(attribute_list, ',', 2) as attributes from boxes b join ordered o on o.token = b.sample_token"""


def i3_velocities(spark, d):
    v = I.velocities(_boxes(spark, d).drop("attribute_tokens"), 90 * 86_400_000_000)
    return v.select("token", *[F.round(F.col(f"v{c}") * 1e6, 6).alias(f"v{c}") for c in "xyz"])


I3 = f"""{_ORDERED}, {_BOXES}, l as (select *, lag(timestamp_us) over w as ta, lead(timestamp_us) over w as tb, lag(x) over w as xa, lead(x) over w as xb, lag(y) over w as ya, lead(y) over w as yb, lag(z) over w as za, lead(z) over w as zb from boxes window w as (partition by instance_token order by timestamp_us, token)),
m as (select *, coalesce(tb, timestamp_us) - coalesce(ta, timestamp_us) as dt from l), g as (select *, dt > 0 and dt <= case when ta is not null and tb is not null then {180 * 86_400_000_000} else {90 * 86_400_000_000} end as ok, dt / 1000000::double as s from m)
select token, round(case when ok then (coalesce(xb, x) - coalesce(xa, x)) / s end * 1e6, 6) as vx, round(case when ok then (coalesce(yb, y) - coalesce(ya, y)) / s end * 1e6, 6) as vy, round(case when ok then (coalesce(zb, z) - coalesce(za, z)) / s end * 1e6, 6) as vz from g"""


def _frames(spark, d, channels=I.TARGET_CHANNELS):
    return I.sensor_frames(_ordered(spark, d), *[_view(spark, d, n) for n in ("src_data", "src_calibrations", "src_sensors", "src_poses")], channels)


_FRAMES = f"""{_ORDERED}, f as (select d.token as frame_id, o.scene_id, o.sample_id, d.channel, case lower(trim(s.modality)) when 'camera' then 'camera' when 'lidar' then 'lidar' when 'radar' then 'radar' else case when d.channel like 'CAM%' then 'camera' when d.channel like 'LIDAR%' then 'lidar' when d.channel like 'RADAR%' then 'radar' else 'unknown' end end as modality,
  d.timestamp_us, d.calibrated_sensor_token as calibration_id, p.timestamp_us as pose_us, d.width, d.height, d.raw_log_id, d.sequence_id, d.pos from src_data d join ordered o on o.token = d.sample_token join src_calibrations c on c.token = d.calibrated_sensor_token left join src_sensors s on s.token = c.sensor_token left join src_poses p on p.token = d.ego_pose_token)"""


def i4_sensor_frames(spark, d):
    return _frames(spark, d).select("frame_id", "sample_id", "channel", "modality", "calibration_id", "pose_us", "width", "height")


I4 = f"""{_FRAMES} select frame_id, sample_id, channel, modality, calibration_id, pose_us, case when modality = 'camera' then nullif(width, 0) end as width, case when modality = 'camera' then nullif(height, 0) end as height from f where channel in ('CAM_FRONT', 'LIDAR_TOP')"""


def i5_registry(spark, d):
    data = _view(spark, d, "src_data")
    tag = lambda df, name: df.select("calibrated_sensor_token", "channel", "pos", F.lit(name).alias("wins"))
    return tag(I.registry(data, ["calibrated_sensor_token"]), "last").union(tag(I.registry(data, ["calibrated_sensor_token"], False), "first"))


I5 = f"""{_ORDERED}, r as (select calibrated_sensor_token, channel, pos, row_number() over (partition by calibrated_sensor_token order by pos) as a, row_number() over (partition by calibrated_sensor_token order by pos desc) as b from src_data)
select calibrated_sensor_token, channel, pos, 'last' as wins from r where b = 1 union all select calibrated_sensor_token, channel, pos, 'first' from r where a = 1"""


def i6_raw_log_headers(spark, d, most=None):
    data = I.first_sequences(_view(spark, d, "src_data"), most).withColumn("modality", I.modality(F.lit(None).cast("string"), F.col("channel")))
    out = I.raw_log_header(data)
    return out.withColumn("channels", F.array_join("channels", ",")).withColumn("modalities", F.array_join("modalities", ","))


I6 = f"""{_ORDERED}, q as (select sequence_id from src_data group by sequence_id order by min(pos)), x as (select *, lower(split_part(channel, '_', 1)) as m from src_data semi join q using (sequence_id))
select raw_log_id, count(*) as frame_count, count(distinct sequence_id) as sequence_count, string_agg(distinct channel, ',' order by channel) as channels, string_agg(distinct case m when 'cam' then 'camera' else m end, ',' order by case m when 'cam' then 'camera' else m end) as modalities, min(timestamp_us) as start_us, max(timestamp_us) as end_us from x group by raw_log_id"""


def i6_first_sequences(spark, d):
    return i6_raw_log_headers(spark, d, 60)


def i7_modalities(spark, d):
    return _frames(spark, d, None).groupBy("channel", "modality").agg(F.count("*").alias("frames"))


def _rollup(spark, d):
    return I.scene_rollup(_ordered(spark, d), _frames(spark, d), _annotations(spark, d))


_ROLLUP = f"""{_FRAMES}, {_BOXES}, ff as (select * from f where channel in ('CAM_FRONT', 'LIDAR_TOP')), s as (select scene_id, count(*) as sample_count, min(timestamp_us) as start_us, max(timestamp_us) as end_us from ordered group by scene_id),
fc as (select scene_id, count(*) as frame_count, string_agg(distinct channel, ',' order by channel) as channels from ff group by scene_id), a as (select scene_id, count(*) as annotation_count from boxes b join ordered o on o.token = b.sample_token group by scene_id),
r as (select scene_id, sample_count, start_us, end_us, coalesce(frame_count, 0) as frame_count, channels, coalesce(annotation_count, 0) as annotation_count from s left join fc using (scene_id) left join a using (scene_id))"""


def i8_scene_rollup(spark, d):
    return _rollup(spark, d).withColumn("channels", F.array_join("channels", ","))


def i9_ingest_totals(spark, d):
    return I.ingest_totals(_rollup(spark, d)).withColumn("channels", F.array_join("channels", ","))


I9 = f"{_ROLLUP} select count(*) as scene_count, cast(sum(sample_count) as bigint) as sample_count, cast(sum(frame_count) as bigint) as frame_count, cast(sum(annotation_count) as bigint) as annotation_count, (select string_agg(distinct channel, ',' order by channel) from ff) as channels from r"


def s9_sensor_uris(spark, d):
    data = _view(spark, d, "src_data")
    root = F.when(F.col("pos") % 2 == 0, "file:///data/raw/").otherwise("/data/raw")
    return data.select(F.col("token"), sensor_uri(root, F.col("filename")).alias("uri"))


_SENSORS = {"camera_rotation": (0.5, -0.5, 0.5, -0.5), "camera_translation": (0.1, 0.0, 0.2), "lidar_rotation": (0.7071067811865476, 0.0, 0.0, 0.7071067811865476), "lidar_translation": (0.0, 0.0, 0.3), "ego_rotation": (0.8775825618903728, 0.0, 0.0, 0.479425538604203), "ego_translation": (10.0, 20.0, 0.5)}


def _detections(spark, d):
    out = _view(spark, d, "detections")
    for name, value in _SENSORS.items():
        out = out.withColumn(name, F.array(*[F.lit(v) for v in value]))
    k = ((50.0, 0.0, 50.0), (0.0, 50.0, 45.0), (0.0, 0.0, 1.0))
    return out.withColumn("intrinsic", F.array(*[F.array(*[F.lit(v) for v in r]) for r in k]))


def d8_scaled_boxes(spark, d):
    boxes = D.scaled_boxes(_detections(spark, d), 1200)
    return boxes.select("detection_id", *[F.round(c, 6).alias(c) for c in ("bx1", "by1", "bx2", "by2")])


D8 = f"""{_with("detections")} select detection_id, round(x1 / least(1200 / greatest(width, height)::double, 1.0), 6) as bx1, round(y1 / least(1200 / greatest(width, height)::double, 1.0), 6) as by1, round(x2 / least(1200 / greatest(width, height)::double, 1.0), 6) as bx2, round(y2 / least(1200 / greatest(width, height)::double, 1.0), 6) as by2 from detections"""


def _frustum(spark, d):
    return D.frustum_points(_detections(spark, d), _view(spark, d, "lidar_points"))


# The sensors above turn (x, y, z) into ego (-y, x, z + 0.3), and that into camera (-ey, 0.2 - ez, ex - 0.1).
_FRUSTUM = f"""{_with("detections", "lidar_points")}, s as (select *, least(1333 / greatest(width, height)::double, 1.0) as k from detections where width is not null),
e as (select detection_id, point_pos, -y as ex, x as ey, z + 0.3 as ez, x1 / k as bx1, x2 / k as bx2, y1 / k as by1, y2 / k as by2 from s join lidar_points p on p.frame_id = s.lidar_frame_id),
c as (select *, -ey as cx, 0.2 - ez as cy, ex - 0.1 as cz from e), i as (select * from c where cz > 0.1 and ez > 0 and 50 * cx / cz + 50 between bx1 and bx2 and 50 * cy / cz + 45 between by1 and by2),
g as (select detection_id, count(*) as frustum_point_count from i group by detection_id having count(*) >= 3), frustum as (select i.*, frustum_point_count from i join g using (detection_id))"""


def d9_ego_points(spark, d):
    return _frustum(spark, d).select("detection_id", "point_pos", *[F.round(c, 6).alias(c) for c in ("ex", "ey", "ez")])


def d10_frustum_counts(spark, d):
    return _frustum(spark, d).groupBy("detection_id").agg(F.count("*").alias("points"))


def _clustered(spark, d):
    return D.clustered(_frustum(spark, d), 0.15, 3)


def d11_clusters(spark, d):
    return _clustered(spark, d).groupBy("detection_id").agg(F.count("*").alias("points"))


# Core points within eps reach each other; another point belongs to the first cluster that has a core point within eps.
_CLUSTERS = f"""{_FRUSTUM.replace("with ", "with recursive ", 1)}, near as (select a.detection_id, a.point_pos as p, b.point_pos as q from frustum a join frustum b on a.detection_id = b.detection_id
  and (a.ex-b.ex)*(a.ex-b.ex) + (a.ey-b.ey)*(a.ey-b.ey) + (a.ez-b.ez)*(a.ez-b.ez) <= 0.15::double * 0.15::double),
core as (select detection_id, p from near group by detection_id, p having count(*) >= 3),
steps as (select n.* from near n semi join core c on c.detection_id = n.detection_id and c.p = n.p semi join core e on e.detection_id = n.detection_id and e.p = n.q),
reach as (select detection_id, p, p as q from core union select r.detection_id, r.p, s.q from reach r join steps s on s.detection_id = r.detection_id and s.p = r.q),
cores as (select detection_id, p, min(q) as cluster from reach group by detection_id, p),
placed as (select n.detection_id, n.p, min(c.cluster) as cluster from near n join cores c on c.detection_id = n.detection_id and c.p = n.q where not exists (select 1 from core x where x.detection_id = n.detection_id and x.p = n.p) group by n.detection_id, n.p
  union all select * from cores),
largest as (select detection_id, cluster from (select detection_id, cluster, row_number() over (partition by detection_id order by count(*) desc, cluster) as rn from placed group by detection_id, cluster) where rn = 1),
cluster as (select f.* from frustum f left join placed p on p.detection_id = f.detection_id and p.p = f.point_pos left join largest l on l.detection_id = f.detection_id where l.cluster is null or p.cluster = l.cluster)"""


def d12_boxes(spark, d):
    b = D.boxes(_clustered(spark, d))
    r = lambda c, i, n: F.round(F.element_at(c, i), 6).alias(n)
    return b.select("detection_id", r("translation", 1, "tx"), r("translation", 2, "ty"), r("translation", 3, "tz"), r("size", 1, "sx"), r("size", 2, "sy"), F.round("yaw", 6).alias("yaw"), "cluster_point_count")


D12 = f"""{_CLUSTERS}, b as (select detection_id, avg(ex) as mx, avg(ey) as my, avg(ez) as mz, max(ex) - min(ex) as sx, max(ey) - min(ey) as sy, covar_pop(ex, ey) as cov, var_pop(ex) - var_pop(ey) as dv, count(*) as n from cluster group by detection_id),
q as (select *, 1 - 2 * 0.479425538604203 * 0.479425538604203 as cs, 2 * 0.8775825618903728 * 0.479425538604203 as sn from b)
select detection_id, round(cs * mx - sn * my + 10, 6) as tx, round(sn * mx + cs * my + 20, 6) as ty, round(mz + 0.5, 6) as tz, round(sx, 6) as sx, round(sy, 6) as sy, round(0.5 * atan2(2 * cov, dv), 6) as yaw, n as cluster_point_count from q"""


def d13_liftable(spark, d):
    return D.liftable(_detections(spark, d)).select("detection_id")


def _echo(**_):
    def model(uris):
        return [[{"label": (" Car", "person", "cat")[sum(u.encode()) % 3], "score": (sum(u.encode()) % 1000) / 999.0, "x1": float(len(u)), "y1": 1.04, "x2": 30.0, "y2": 40.0}] * (sum(u.encode()) % 4) for u in uris]

    return model


def d4_inference(spark, d):
    images = _view(spark, d, "src_data").where("channel = 'CAM_FRONT'").select("token", F.col("filename").alias("image_uri"))
    return N.detect(images, _echo).select("token", F.size("detections").cast("long").alias("detections"))


def d5_categories(spark, d):
    images = _view(spark, d, "src_data").where("channel = 'CAM_FRONT'").select("token", F.col("filename").alias("image_uri"))
    return N.cleaned(N.detect(images, _echo)).select("token", "raw_pos", "category", "score", "x1", "y1")


_ECHO = f"""{_with("src_data")}, u as (select token, filename, length(filename) as n, list_sum(list_transform(string_split(filename, ''), lambda c: ascii(c))) as s from src_data where channel = 'CAM_FRONT')"""
D5 = f"""{_ECHO} select token, cast(unnest(generate_series(0, cast(s % 4 as bigint) - 1)) as integer) as raw_pos, case s % 3 when 0 then 'vehicle.car' else 'human.pedestrian.adult' end as category,
  round((s % 1000) / 999.0::double, 4) as score, n::double as x1, 1.0::double as y1 from u where s % 4 > 0 and s % 3 < 2"""


def d6_prediction_records(spark, d):
    out = D.prediction_records(_detections(spark, d), D.boxes(_clustered(spark, d)))
    return out.select("prediction_id", "category", "lifting_method", "lifting_status", "cluster_point_count", F.round(F.element_at("translation", 1), 6).alias("tx"))


D6 = f"""{D12.replace("select detection_id, round(cs", ", bx as (select detection_id, round(cs", 1)})
select sample_id || '-gdino-' || case when det_pos < 10000 then lpad(cast(det_pos as varchar), 4, '0') else cast(det_pos as varchar) end as prediction_id, category, case when b.detection_id is not null then 'frustum_lidar' else 'none' end as lifting_method,
case when lift_failed then 'failed' when b.detection_id is not null then 'succeeded' else 'not_applicable' end as lifting_status, cluster_point_count, coalesce(tx, 0.0) as tx from detections d left join bx b using (detection_id)"""

QUERIES = {
    "i1_ordered_samples": (i1_ordered_samples, f"{_ORDERED} select token, scene_id, frame_index, sample_id from ordered"),
    "i1_linked_samples": (i1_linked_samples, I1_LINKED),
    "i2_annotations": (i2_annotations, I2),
    "i3_velocities": (i3_velocities, I3),
    "i4_sensor_frames": (i4_sensor_frames, I4),
    "i5_registry": (i5_registry, I5),
    "i6_raw_log_headers": (i6_raw_log_headers, I6),
    "i6_first_sequences": (i6_first_sequences, I6.replace("order by min(pos))", "order by min(pos) limit 60)")),
    "i7_modalities": (i7_modalities, f"{_FRAMES} select channel, modality, count(*) as frames from f group by all"),
    "i8_scene_rollup": (i8_scene_rollup, f"{_ROLLUP} select *, annotation_count > 0 as has_ground_truth, case when annotation_count > 0 then 'source' end as ground_truth_source from r"),
    "i9_ingest_totals": (i9_ingest_totals, I9),
    "s9_sensor_uris": (s9_sensor_uris, f"{_ORDERED} select token, 'file:///data/raw/' || filename as uri from src_data"),
    "d4_inference": (d4_inference, f"{_ECHO} select token, cast(s % 4 as bigint) as detections from u"),
    "d5_categories": (d5_categories, D5),
    "d6_prediction_records": (d6_prediction_records, D6),
    "d8_scaled_boxes": (d8_scaled_boxes, D8),
    "d9_ego_points": (d9_ego_points, f"{_FRUSTUM} select detection_id, point_pos, round(ex, 6) as ex, round(ey, 6) as ey, round(ez, 6) as ez from frustum"),
    "d10_frustum_counts": (d10_frustum_counts, f"{_FRUSTUM} select detection_id, frustum_point_count as points from g"),
    "d11_clusters": (d11_clusters, f"{_CLUSTERS} select detection_id, count(*) as points from cluster group by detection_id"),
    "d12_boxes": (d12_boxes, D12),
    "d13_liftable": (d13_liftable, f"{_with('detections')} select detection_id from detections where width is not null"),
}
