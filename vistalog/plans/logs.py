"""Queries over raw logs: segmentation, anchors and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import associate as J
from ..operators import sampling as A
from ..operators import segment as G
from ..operators.steps import written
from .adapters import ctes, view

HOUR = 3_600_000_000
GAP = 6 * HOUR


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "raw_frames")


def _gaps(spark: SparkSession, d: str, **more) -> DataFrame:
    """Segments by gaps; frames without a sequence are one large group, so groups are cut by time."""
    return G.segments(_frames(spark, d), "log", "gap_based", max_gap_us=GAP, **{"bucket_us": 96 * HOUR} | more)


def _joined(channels: str = "channels") -> object:
    return F.array_join(channels, ",").alias("channels")


_GROUPED = "grouped as (select *, coalesce(nullif(sequence_id, ''), 'default') as group_key from raw_frames)"
_GAPS = """gaps as (select *, cast(sum(cut) over (partition by group_key order by timestamp_us, pos) as bigint) as chunk from (
  select *, case when timestamp_us - lag(timestamp_us) over (partition by group_key order by timestamp_us, pos) > 21600000000 then 1 else 0 end as cut from grouped))"""
_WITH = f"with recursive {ctes('raw_frames', 'ego_poses', 'calibrations')},\n{_GROUPED},\n{_GAPS}"


def _numbered(source: str, kind: str, least: int, span: int = 0) -> str:
    """Frames of source (group_key, chunk, part) with segment_id; short parts are left out."""
    return f"""
sizes as (select group_key, chunk, part, count(*) as n, max(timestamp_us) - min(timestamp_us) as span from {source} group by all),
named as (select group_key, chunk, part, row_number() over (partition by group_key order by chunk, part) - 1 as segment_index from sizes where n >= {least} and span >= {span}),
segmented as (select s.*, segment_index, {"case when segment_index = 0 then s.group_key else " if kind == "seq" else ""}
  'log-' || translate(s.group_key, '/ ', '__') || '-{kind}' || case when segment_index < 10000 then lpad(cast(segment_index as varchar), 4, '0') else cast(segment_index as varchar) end
  {"end" if kind == "seq" else ""} as segment_id from {source} s join named using (group_key, chunk, part))"""


_SEGMENTED = f"{_WITH},\nparts as (select *, 0 as part from gaps),{_numbered('parts', 'gap', 2)}"
_ROLLUP = """select segment_id, group_key, cast(segment_index as bigint) as segment_index, min(timestamp_us) as start_us, max(timestamp_us) as end_us, count(*) as frame_count,
  string_agg(distinct channel, ',' order by channel) as channels from segmented group by segment_id, group_key, segment_index"""


def g1_grouped(spark, d):
    g = lambda **k: G.group_frames(_frames(spark, d), "log", **k)
    tag = lambda df, name: df.groupBy("group_key").agg(F.count("*").alias("frames")).withColumn("policy", F.lit(name))
    return tag(g(), "default").union(tag(g(missing="drop"), "drop")).union(tag(g(respect_sequence_id=False), "ignore"))


G1 = f"""{_WITH} select group_key, count(*) as frames, 'default' as policy from grouped group by group_key
union all select sequence_id, count(*), 'drop' from raw_frames where nullif(sequence_id, '') is not null group by sequence_id
union all select 'log', count(*), 'ignore' from raw_frames"""


def _segment_rows(df: DataFrame) -> DataFrame:
    r = G.rollup(df)
    return r.select("segment_id", "group_key", "segment_index", "start_us", "end_us", "frame_count", _joined())


def g2_sequence_segments(spark, d):
    return _segment_rows(G.segments(_frames(spark, d), "log", "sequence"))


G2 = f"{_WITH}, parts as (select *, 0 as chunk, 0 as part from grouped),{_numbered('parts', 'seq', 1)} {_ROLLUP}"


def g3_gap_segments(spark, d):
    return _segment_rows(_gaps(spark, d, min_frame_count=2, bucket_us=None))


G3 = f"{_SEGMENTED} {_ROLLUP}"


def g3_bucketed_segments(spark, d):
    return _segment_rows(_gaps(spark, d, min_frame_count=2, bucket_us=24 * HOUR))


def g8_segments(spark, d):
    """Segments with their frames in order, in order of start."""
    segmented = _gaps(spark, d, min_frame_count=2)
    ids = segmented.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_us", "pos", "frame_id"))), lambda s: s["frame_id"]), ",").alias("frame_ids"))
    return G.rollup(segmented).join(ids, "segment_id").select("segment_id", "start_us", "end_us", "frame_ids", _joined()).orderBy("start_us", "segment_id")


G8 = f"""{_SEGMENTED} select segment_id, min(timestamp_us) as start_us, max(timestamp_us) as end_us, string_agg(frame_id, ',' order by timestamp_us, pos) as frame_ids, string_agg(distinct channel, ',' order by channel) as channels from segmented group by segment_id"""


def _windows(spark, d, duration, stride):
    return _segment_rows(G.segments(_frames(spark, d), "log", "fixed_window", duration_us=duration, stride_us=stride))


def _windows_sql(duration: int, stride: int) -> str:
    return f"""{_WITH},
firsts as (select group_key, min(timestamp_us) as first_us from grouped group by group_key),
parts as (select g.*, cast(k as bigint) as chunk, 0 as part from grouped g join firsts using (group_key),
  lateral (select unnest(generate_series(greatest(0, cast(floor((timestamp_us - first_us - {duration}) / {stride}::double) as bigint) + 1), cast(floor((timestamp_us - first_us) / {stride}::double) as bigint))) as k)),
{_numbered('parts', 'win', 1)} {_ROLLUP}"""


def g4_overlapping_windows(spark, d):
    return _windows(spark, d, 48 * HOUR, 24 * HOUR)


def g4_windows_with_holes(spark, d):
    return _windows(spark, d, 48 * HOUR, 72 * HOUR)


def g5_limited_segments(spark, d):
    return _segment_rows(_gaps(spark, d, max_duration_us=2 * HOUR, max_frame_count=3))


G5 = f"""{_WITH},
ordered as (select *, row_number() over (partition by group_key, chunk order by timestamp_us, pos) as rn from gaps),
walk as (
  select group_key, chunk, rn, frame_id, timestamp_us, channel, pos, cast(0 as bigint) as part, timestamp_us as first_us, 1 as cnt from ordered where rn = 1
  union all
  select o.group_key, o.chunk, o.rn, o.frame_id, o.timestamp_us, o.channel, o.pos,
    case when o.timestamp_us - w.first_us > {2 * HOUR} or w.cnt + 1 > 3 then w.part + 1 else w.part end,
    case when o.timestamp_us - w.first_us > {2 * HOUR} or w.cnt + 1 > 3 then o.timestamp_us else w.first_us end,
    case when o.timestamp_us - w.first_us > {2 * HOUR} or w.cnt + 1 > 3 then 1 else w.cnt + 1 end
  from walk w join ordered o on o.group_key = w.group_key and o.chunk = w.chunk and o.rn = w.rn + 1),
{_numbered('walk', 'gap', 1)} {_ROLLUP}"""


def g5_counted_segments(spark, d):
    return _segment_rows(_gaps(spark, d, max_frame_count=3, min_frame_count=2, min_duration_us=HOUR))


G5C = f"""{_WITH},
parts as (select *, cast(floor((row_number() over (partition by group_key, chunk order by timestamp_us, pos) - 1) / 3) as bigint) as part from gaps),
{_numbered('parts', 'gap', 2, HOUR)} {_ROLLUP}"""


def g6_short_segments(spark, d):
    frames = G.gap_chunks(G.group_frames(_frames(spark, d), "log"), GAP).withColumn("part", F.lit(0).cast("long"))
    return G.drop_short(frames, 2, HOUR).select("group_key", "chunk", "frame_id")


G6 = f"""{_WITH}, good as (select group_key, chunk from gaps group by all having count(*) >= 2 and max(timestamp_us) - min(timestamp_us) >= {HOUR})
select group_key, chunk, frame_id from gaps semi join good using (group_key, chunk)"""


def g7_segment_ids(spark, d):
    return _gaps(spark, d, min_frame_count=2).select("frame_id", "segment_id", "segment_index")


G7 = f"{_SEGMENTED} select frame_id, segment_id, cast(segment_index as bigint) as segment_index from segmented"


def _segmented(spark, d):
    """Segments built once, for queries that use them several times."""
    return written(_gaps(spark, d, min_frame_count=2), "segmented")


def _anchored(spark, d, frames=None):
    frames = _segmented(spark, d) if frames is None else frames
    return frames, A.capped(A.channel_anchors(frames, "view"), None)


_ANCHORS = f"""{_SEGMENTED},
anchors as (select segment_id, timestamp_us, anchor_frame_id, anchor_pos, row_number() over (partition by segment_id order by timestamp_us, anchor_pos) - 1 as anchor_index from (
  select segment_id, timestamp_us, frame_id as anchor_frame_id, pos as anchor_pos, channel, max(case when channel = 'view' then 1 else 0 end) over (partition by segment_id) as has from segmented)
  where has = 0 or channel = 'view'),
targets as (select distinct segment_id, channel from segmented),
asks as (select a.*, t.channel from anchors a join targets t using (segment_id))"""


def g9_built_segments(spark, d):
    frames, anchors = _anchored(spark, d)
    built = G.first_built(G.rollup(frames), anchors.where("anchor_frame_id is not null"), 500)
    return built.select("segment_id", "start_us")


G9 = f"""{_ANCHORS}, r as (select segment_id, group_key, segment_index, min(timestamp_us) as start_us from segmented group by all)
select segment_id, start_us from r semi join anchors using (segment_id) order by start_us, group_key, segment_index limit 500"""


def a1_channel_anchors(spark, d):
    return _anchored(spark, d)[1].select("segment_id", "anchor_index", "timestamp_us", "anchor_frame_id")


A1 = f"{_ANCHORS} select segment_id, anchor_index, timestamp_us, anchor_frame_id from anchors"


def a2_interval_anchors(spark, d):
    return A.interval_anchors(G.rollup(_gaps(spark, d, min_frame_count=2)), HOUR).select("segment_id", "anchor_pos", "timestamp_us")


A2 = f"""{_SEGMENTED}, r as (select segment_id, min(timestamp_us) as start_us, max(timestamp_us) as end_us from segmented group by segment_id)
select segment_id, cast(k as bigint) as anchor_pos, start_us + k * {HOUR} as timestamp_us from r, lateral (select unnest(generate_series(0, (end_us - start_us) // {HOUR})) as k)"""


def a3_every_nth(spark, d):
    return A.every_nth(_anchored(spark, d)[1].drop("anchor_index"), 3).select("segment_id", "anchor_frame_id")


A3 = f"{_ANCHORS} select segment_id, anchor_frame_id from anchors where anchor_index % 3 = 0"


def a4_spaced_anchors(spark, d):
    return A.spaced(_anchored(spark, d)[1].drop("anchor_index"), 3 * HOUR).select("segment_id", "anchor_frame_id")


A4 = f"""{_ANCHORS},
kept as (
  select segment_id, anchor_index, anchor_frame_id, timestamp_us as last_us, true as keep from anchors where anchor_index = 0
  union all
  select a.segment_id, a.anchor_index, a.anchor_frame_id, case when a.timestamp_us - k.last_us >= {3 * HOUR} then a.timestamp_us else k.last_us end, a.timestamp_us - k.last_us >= {3 * HOUR}
  from kept k join anchors a on a.segment_id = k.segment_id and a.anchor_index = k.anchor_index + 1)
select segment_id, anchor_frame_id from kept where keep"""


def a5_thinned_anchors(spark, d):
    return A.thin(_anchored(spark, d)[1].drop("anchor_index"), 2, None, 2).select("segment_id", "anchor_index", "anchor_frame_id")


A5 = f"""{_ANCHORS}, n as (select segment_id, anchor_frame_id, row_number() over (partition by segment_id order by anchor_index) - 1 as anchor_index from anchors where anchor_index % 2 = 0)
select segment_id, anchor_index, anchor_frame_id from n where anchor_index < 2"""


def j1_target_channels(spark, d):
    return J.target_channels(_gaps(spark, d, min_frame_count=2))


def _associated(spark, d, strategy="nearest", frames=None):
    frames, anchors = _anchored(spark, d, frames)
    return J.associate(anchors, frames, J.target_channels(frames), strategy, 3 * HOUR)


def _association(spark, d, strategy):
    return _associated(spark, d, strategy).select("segment_id", "anchor_index", "channel", "frame_id", "offset_us")


def j2_nearest_frames(spark, d):
    return _association(spark, d, "nearest")


def j3_previous_frames(spark, d):
    return _association(spark, d, "previous")


def j4_next_frames(spark, d):
    return _association(spark, d, "next")


def _assoc_sql(condition: str) -> str:
    return f"""{_ANCHORS},
ranked as (select a.segment_id, a.anchor_index, a.channel, a.timestamp_us, s.frame_id, s.timestamp_us - a.timestamp_us as offset_us,
  row_number() over (partition by a.segment_id, a.anchor_index, a.channel order by abs(s.timestamp_us - a.timestamp_us), s.timestamp_us, s.pos) as rn
  from asks a left join segmented s on s.segment_id = a.segment_id and s.channel = a.channel and abs(s.timestamp_us - a.timestamp_us) <= {3 * HOUR} and {condition}),
associated as (select segment_id, anchor_index, channel, timestamp_us, frame_id, offset_us from ranked where rn = 1)"""


_OUT = "select segment_id, anchor_index, channel, frame_id, offset_us from associated"
_NEAREST = _assoc_sql("true")


def j5_frames_once(spark, d):
    frames, anchors = _anchored(spark, d)
    return J.associate_once(anchors, frames, J.target_channels(frames), "nearest", 3 * HOUR).select("segment_id", "anchor_index", "channel", "frame_id", "offset_us")


J5 = f"""{_ANCHORS},
near as (select a.segment_id, a.channel, a.anchor_index, a.timestamp_us, s.frame_id, s.timestamp_us as frame_us, s.pos from asks a join segmented s on s.segment_id = a.segment_id and s.channel = a.channel and abs(s.timestamp_us - a.timestamp_us) <= {3 * HOUR}),
asked as (select *, dense_rank() over (partition by segment_id, channel order by anchor_index) as k from near),
turns as (select distinct segment_id, channel, k, anchor_index from asked),
walk as (
  select segment_id, channel, cast(0 as bigint) as k, []::bigint[] as taken, null::bigint as anchor_index, null::varchar as frame_id, null::bigint as frame_us from (select distinct segment_id, channel from asked)
  union all
  select w.segment_id, w.channel, w.k + 1, case when b.pos is null then w.taken else list_append(w.taken, b.pos) end, t.anchor_index, b.frame_id, b.frame_us
  from walk w join turns t on t.segment_id = w.segment_id and t.channel = w.channel and t.k = w.k + 1
  left join lateral (select x.pos, x.frame_id, x.frame_us from asked x where x.segment_id = w.segment_id and x.channel = w.channel and x.k = w.k + 1 and not list_contains(w.taken, x.pos)
    order by abs(x.frame_us - x.timestamp_us), x.frame_us, x.pos limit 1) b on true)
select a.segment_id, a.anchor_index, a.channel, w.frame_id, w.frame_us - a.timestamp_us as offset_us from asks a left join walk w on w.segment_id = a.segment_id and w.channel = a.channel and w.anchor_index = a.anchor_index"""


def _samples(spark, d):
    return J.missing_channels(_associated(spark, d))


_SAMPLES = f"""{_NEAREST},
samples as (select segment_id, anchor_index, count(frame_id) as frame_count, count(*) - count(frame_id) as lost, string_agg(case when frame_id is null then channel end, ',' order by channel) as missing from associated group by all),
kept as (select * from samples where frame_count > 0 and (missing is null or not list_contains(string_split(missing, ','), 'click')))"""


def j6_missing_channels(spark, d):
    return J.sample_id(_samples(spark, d)).select("sample_id", "frame_count", F.array_join("missing_channels", ",").alias("missing"))


J6 = f"{_SAMPLES} select segment_id || '-sample-' || lpad(cast(anchor_index as varchar), 6, '0') as sample_id, frame_count, coalesce(missing, '') as missing from samples"


def j7_calibrated_frames(spark, d):
    return J.resolve_calibrations(_frames(spark, d), view(spark, d, "calibrations")).select("frame_id", "calibration_id", "has_intrinsic")


J7 = f"""{_WITH} select f.frame_id, coalesce(s.calibration_id, c.calibration_id) as calibration_id, coalesce(s.has_intrinsic, c.has_intrinsic) as has_intrinsic
from raw_frames f left join calibrations s on s.sensor_id = f.sensor_id left join calibrations c on c.channel = f.channel"""


def j8_nearest_pose(spark, d):
    return J.nearest_pose(_frames(spark, d), view(spark, d, "ego_poses"), 360_000_000).select("frame_id", "ego_pose_id")


J8 = f"""{_WITH},
after as (select f.frame_id, p.timestamp_us as t, p.ego_pose_id, f.timestamp_us as ft, row_number() over (partition by f.frame_id order by p.timestamp_us, p.pos) as rn from raw_frames f join ego_poses p on p.timestamp_us between f.timestamp_us and f.timestamp_us + 360000000),
before as (select f.frame_id, p.timestamp_us as t, p.ego_pose_id, f.timestamp_us as ft, row_number() over (partition by f.frame_id order by p.timestamp_us desc, p.pos desc) as rn from raw_frames f join ego_poses p on p.timestamp_us < f.timestamp_us and p.timestamp_us >= f.timestamp_us - 360000000)
select f.frame_id, case when a.t is null then b.ego_pose_id when b.t is null then a.ego_pose_id when a.t - a.ft <= b.ft - b.t then a.ego_pose_id else b.ego_pose_id end as ego_pose_id
from raw_frames f left join (select * from after where rn = 1) a using (frame_id) left join (select * from before where rn = 1) b using (frame_id)"""


def j9_exact_pose(spark, d):
    return J.exact_pose(_frames(spark, d), view(spark, d, "ego_poses")).select("frame_id", "ego_pose_id")


J9 = f"""{_WITH}, p as (select timestamp_us, ego_pose_id, row_number() over (partition by timestamp_us order by pos) as rn from ego_poses)
select f.frame_id, p.ego_pose_id from raw_frames f left join p on p.timestamp_us = f.timestamp_us and p.rn = 1"""


def x7_interpolated_pose(spark, d):
    return J.interpolated_pose(_frames(spark, d), view(spark, d, "ego_poses"), 360_000_000).select("frame_id", F.round("x", 6).alias("x"))


X7 = f"""{_WITH},
a as (select f.frame_id, p.timestamp_us as t, p.x, f.timestamp_us as ft, row_number() over (partition by f.frame_id order by p.timestamp_us, p.pos) as rn from raw_frames f join ego_poses p on p.timestamp_us between f.timestamp_us and f.timestamp_us + 360000000),
b as (select f.frame_id, p.timestamp_us as t, p.x, f.timestamp_us as ft, row_number() over (partition by f.frame_id order by p.timestamp_us desc, p.pos) as rn from raw_frames f join ego_poses p on p.timestamp_us between f.timestamp_us - 360000000 and f.timestamp_us)
select f.frame_id, round(case when a.t = b.t then b.x else b.x + (b.ft - b.t) / nullif(a.t - b.t, 0)::double * (a.x - b.x) end, 6) as x
from raw_frames f left join (select * from a where rn = 1) a using (frame_id) left join (select * from b where rn = 1) b using (frame_id)"""


def x7_interpolated_transform(spark, d):
    """Poses turn with their value, about an axis between x and z, and some quaternions stand for the far arc."""
    angle, far = F.col("x") / 40, F.when(F.col("pos") % 2 == 0, -1.0).otherwise(1.0)
    rotation = F.array(far * F.cos(angle / 2), far * 0.6 * F.sin(angle / 2), F.lit(0.0), far * 0.8 * F.sin(angle / 2))
    poses = view(spark, d, "ego_poses").select("ego_pose_id", "timestamp_us", "pos", F.array("x", F.col("x") * 2, F.col("pos").cast("double")).alias("translation"), rotation.alias("rotation"))
    out = J.interpolated_transform(_frames(spark, d), poses, 360_000_000)
    r = lambda c, i, n: F.round(F.element_at(c, i), 6).alias(n)
    # The sign of a quaternion is free: the first part that is not zero is made positive.
    sign = F.when(F.element_at("rotation", 1) < 0, -1.0).otherwise(1.0)
    out = out.withColumn("turned", F.transform("rotation", lambda c: c * sign))
    return out.select("frame_id", *[r("translation", i + 1, f"t{n}") for i, n in enumerate("xyz")], *[r("turned", i + 1, f"r{n}") for i, n in enumerate("wxyz")])


X7T = f"""{_WITH},
poses as (select *, case when pos % 2 = 0 then -1.0 else 1.0 end::double as s, x / 80 as h from ego_poses), p as (select timestamp_us as t, pos, x, x * 2 as y, pos::double as z, s * cos(h) as qw, s * 0.6::double * sin(h) as qx, s * 0.8::double * sin(h) as qz from poses),
a as (select f.frame_id, p.*, row_number() over (partition by f.frame_id order by p.t, p.pos) as rn from raw_frames f join p on p.t between f.timestamp_us and f.timestamp_us + 360000000),
b as (select f.frame_id, p.*, row_number() over (partition by f.frame_id order by p.t desc, p.pos) as rn from raw_frames f join p on p.t between f.timestamp_us - 360000000 and f.timestamp_us),
m as (select f.frame_id, coalesce((f.timestamp_us - b.t) / nullif(a.t - b.t, 0)::double, 0.0) as k, b.x as bx, b.y as b_y, b.z as bz, a.x as ax, a.y as a_y, a.z as az, b.qw as bw, b.qx as bqx, b.qz as bqz, a.qw * sg as aw, a.qx * sg as aqx, a.qz * sg as aqz, least(abs(dt), 1.0) as dot
  from raw_frames f join (select * from a where rn = 1) a using (frame_id) join (select * from b where rn = 1) b using (frame_id), lateral (select a.qw * b.qw + a.qx * b.qx + a.qz * b.qz as dt), lateral (select case when dt < 0 then -1.0 else 1.0 end::double as sg)),
w as (select *, case when dot > 1 - 1e-10 then 1 - k else sin((1 - k) * acos(dot)) / nullif(sin(acos(dot)), 0) end as wb, case when dot > 1 - 1e-10 then k else sin(k * acos(dot)) / nullif(sin(acos(dot)), 0) end as wa from m),
q as (select *, wb * bw + wa * aw as rw, wb * bqx + wa * aqx as rx, wb * bqz + wa * aqz as rz from w), n as (select *, sqrt(rw * rw + rx * rx + rz * rz) * case when rw < 0 then -1 else 1 end as l from q)
select f.frame_id, round(bx * (1 - k) + ax * k, 6) as tx, round(b_y * (1 - k) + a_y * k, 6) as ty, round(bz * (1 - k) + az * k, 6) as tz, round(rw / l, 6) as rw, round(rx / l, 6) as rx, case when l is not null then 0.0::double end as ry, round(rz / l, 6) as rz from raw_frames f left join n using (frame_id)"""


def j10_image_metadata(spark, d):
    frames = view(spark, d, "sample_frames").withColumn("fileformat", F.lit(None).cast("string"))
    return J.image_metadata(frames).select("frame_id", "channel", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image").isNotNull().alias("has_image"))


J10 = f"""with {ctes('sample_frames')} select frame_id, channel, case when modality = 'camera' then width end as width, case when modality = 'camera' then height end as height,
modality = 'camera' and (width is not null or height is not null) as has_image from sample_frames"""


def j11_kept_samples(spark, d):
    return J.kept_samples(_samples(spark, d), True, ["click"]).select("segment_id", "anchor_index", "frame_count")


J11 = f"{_SAMPLES} select segment_id, anchor_index, frame_count from kept"


def j12_grouping_report(spark, d):
    return J.grouping_totals(J.grouping_report(_samples(spark, d), True, ["click"]))


J12 = f"""{_SAMPLES},
r as (select segment_id, count(*) as before, count(k.anchor_index) as after, count(*) - count(k.anchor_index) as dropped, count(case when lost > 0 then 1 end) as with_missing,
  coalesce(sum(case when k.anchor_index is not null then s.frame_count end), 0) as associated_frames from samples s left join (select segment_id, anchor_index from kept) k using (segment_id, anchor_index) group by segment_id)
select segment_id, cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after, cast(sum(dropped) as bigint) as dropped, cast(sum(with_missing) as bigint) as with_missing, cast(sum(associated_frames) as bigint) as associated_frames
from r group by rollup(segment_id)"""


def j12_missing_by_channel(spark, d):
    return J.missing_by_channel(_samples(spark, d))


J12M = f"{_NEAREST} select segment_id, channel, count(*) as missing from associated where frame_id is null group by all"


def _resolved(spark, d):
    frames = _associated(spark, d).where("frame_id is not null").select("segment_id", "anchor_index", "channel", "frame_id", (F.col("timestamp_us") + F.col("offset_us")).alias("frame_us"))
    cal = J.resolve_calibrations(_frames(spark, d).where("channel <> 'purchase'"), view(spark, d, "calibrations"))
    posed = J.nearest_pose(cal, view(spark, d, "ego_poses"), 360_000_000).select("frame_id", "calibration_id", "ego_pose_id")
    return frames.join(posed, "frame_id", "left")


def j13_resolution_stats(spark, d):
    return J.resolution_stats(_resolved(spark, d))


J13 = f"""{_NEAREST}, cal as ({J7.removeprefix(_WITH)} where f.channel <> 'purchase'),
posed as ({J8.replace(_WITH + ",", "with", 1)}),
r as (select a.segment_id, a.anchor_index, a.frame_id, c.calibration_id, case when c.frame_id is not null then p.ego_pose_id end as ego_pose_id
  from associated a left join cal c using (frame_id) left join posed p using (frame_id) where a.frame_id is not null)
select segment_id, count(*) as frames, count(*) - count(calibration_id) as frames_without_calibration, count(*) - count(ego_pose_id) as frames_without_pose,
  count(distinct case when calibration_id is null then anchor_index end) as samples_without_calibration, count(distinct case when ego_pose_id is null then anchor_index end) as samples_without_pose
from r group by segment_id"""


def j14_scenes(spark, d):
    segmented = _segmented(spark, d)
    segs, associated = G.rollup(segmented), written(_associated(spark, d, frames=segmented), "associated")
    kept = J.kept_samples(J.missing_channels(associated), True, ["click"])
    frames = associated.where("frame_id is not null").join(kept, ["segment_id", "anchor_index"], "left_semi")
    return J.assemble(segs, kept, frames).select("segment_id", "start_us", "end_us", "sample_count", "frame_count", _joined())


J14 = f"""{_SAMPLES},
r as (select segment_id, min(timestamp_us) as start_us, max(timestamp_us) as end_us from segmented group by segment_id),
f as (select a.* from associated a semi join kept using (segment_id, anchor_index) where frame_id is not null),
n as (select segment_id, count(*) as sample_count from kept group by segment_id)
select segment_id, start_us, end_us, sample_count, count(*) as frame_count, string_agg(distinct channel, ',' order by channel) as channels from r join n using (segment_id) join f using (segment_id) group by all"""


def j15_segment_frames(spark, d):
    bridge = _gaps(spark, d, min_frame_count=2).select("segment_id", "frame_id")
    return G.frames_of(bridge, _frames(spark, d).where("modality = 'camera'")).select("segment_id", "frame_id", "timestamp_us", "uri")


J15 = f"{_SEGMENTED} select segment_id, frame_id, timestamp_us, uri from segmented where modality = 'camera'"

QUERIES = {
    "g1_grouped_frames": (g1_grouped, G1),
    "g2_sequence_segments": (g2_sequence_segments, G2),
    "g3_gap_segments": (g3_gap_segments, G3),
    "g3_bucketed_segments": (g3_bucketed_segments, G3),
    "g4_overlapping_windows": (g4_overlapping_windows, _windows_sql(48 * HOUR, 24 * HOUR)),
    "g4_windows_with_holes": (g4_windows_with_holes, _windows_sql(48 * HOUR, 72 * HOUR)),
    "g5_limited_segments": (g5_limited_segments, G5),
    "g5_counted_segments": (g5_counted_segments, G5C),
    "g6_short_segments": (g6_short_segments, G6),
    "g7_segment_ids": (g7_segment_ids, G7),
    "g8_segments": (g8_segments, G8),
    "g9_built_segments": (g9_built_segments, G9),
    "a1_channel_anchors": (a1_channel_anchors, A1),
    "a2_interval_anchors": (a2_interval_anchors, A2),
    "a3_every_nth": (a3_every_nth, A3),
    "a4_spaced_anchors": (a4_spaced_anchors, A4),
    "a5_thinned_anchors": (a5_thinned_anchors, A5),
    "j1_target_channels": (j1_target_channels, f"{_SEGMENTED} select distinct segment_id, channel from segmented"),
    "j2_nearest_frames": (j2_nearest_frames, f"{_NEAREST} {_OUT}"),
    "j3_previous_frames": (j3_previous_frames, f"{_assoc_sql('s.timestamp_us <= a.timestamp_us')} {_OUT}"),
    "j4_next_frames": (j4_next_frames, f"{_assoc_sql('s.timestamp_us >= a.timestamp_us')} {_OUT}"),
    "j5_frames_once": (j5_frames_once, J5),
    "j6_missing_channels": (j6_missing_channels, J6),
    "j7_calibrated_frames": (j7_calibrated_frames, J7),
    "j8_nearest_pose": (j8_nearest_pose, J8),
    "j9_exact_pose": (j9_exact_pose, J9),
    "j10_image_metadata": (j10_image_metadata, J10),
    "j11_kept_samples": (j11_kept_samples, J11),
    "j12_grouping_report": (j12_grouping_report, J12),
    "j12_missing_by_channel": (j12_missing_by_channel, J12M),
    "j13_resolution_stats": (j13_resolution_stats, J13),
    "j14_scenes": (j14_scenes, J14),
    "j15_segment_frames": (j15_segment_frames, J15),
    "x7_interpolated_pose": (x7_interpolated_pose, X7),
    "x7_interpolated_transform": (x7_interpolated_transform, X7T),
}
