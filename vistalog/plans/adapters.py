"""The given tables in the shapes that operators take: raw logs, scenes, annotations, runs and jobs.

Each view is one SQL text for Spark and DuckDB, after two substitutions: US(c) is microseconds of a timestamp and
EL(a,i) the i-th element of an array, counted from 1, as a double.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "raw_frames": """
        select cast(event_id as string) as frame_id, US(ts) as timestamp_us, event_type as channel,
          case event_type when 'view' then 'camera' when 'click' then 'lidar' when 'error' then 'radar' else 'unknown' end as modality,
          concat('s3://raw/', cast(event_id as string)) as uri,
          case when event_id % 97 = 0 then null else cast(user_id as string) end as sequence_id,
          case when event_id % 3 = 0 then null else concat('sensor-', event_type) end as sensor_id, event_id as pos
        from events""",
    "calibrations": """
        select concat('cal-', event_type) as calibration_id, concat('sensor-', event_type) as sensor_id, event_type as channel,
          event_type <> 'purchase' as has_intrinsic, min(event_id) as pos
        from events where event_type <> 'signup' group by event_type""",
    "ego_poses": "select cast(event_id as string) as ego_pose_id, US(ts) as timestamp_us, value as x, event_id as pos from events where event_id % 5 = 0",
    "scenes": """
        select cast(o.o_orderkey as string) as scene_id, concat('ds-', substr(o.o_orderpriority, 1, 1)) as dataset_id, 'v1' as dataset_version,
          case o.o_orderstatus when 'F' then 'profiled' when 'O' then 'validated' else 'built' end as status,
          coalesce(l.samples, 0) as sample_count, coalesce(l.frames, 0) as frame_count, coalesce(l.anns, 0) as annotation_count,
          coalesce(l.anns, 0) > 0 as has_ground_truth, case when coalesce(l.anns, 0) > 0 then 'source' end as ground_truth_source, US(o.o_orderdate) as created_us
        from orders o left join (
          select l_orderkey, count(distinct l_linenumber) as samples, count(*) as frames, count(case when l_returnflag = 'R' then 1 end) as anns
          from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey""",
    "scene_channels": """
        select distinct cast(l_orderkey as string) as scene_id,
          case l_returnflag when 'A' then 'CAM_FRONT' when 'N' then 'LIDAR_TOP' else 'RADAR_FRONT' end as channel from lineitem""",
    "scene_runs": """
        select cast(l_orderkey as string) as scene_id, case when l_linestatus = 'O' then 'scene_validation' else 'scene_profile' end as type,
          case l_returnflag when 'A' then 'ready' when 'N' then 'warning' else 'failed' end as validation_status,
          l_returnflag = 'R' and l_discount > 0.05 as should_block_pipeline, US(l_shipdate) as created_us,
          concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string)) as run_id
        from lineitem""",
    "sample_frames": """
        select concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_linenumber as string)) as frame_id,
          cast(l_orderkey as string) as scene_id, concat(cast(l_orderkey as string), '-s', cast(l_linenumber as string)) as sample_id,
          case l_returnflag when 'A' then 'CAM_FRONT' when 'N' then 'LIDAR_TOP' else 'RADAR_FRONT' end as channel,
          case when l_returnflag = 'A' then 'camera' when l_returnflag = 'N' and l_tax > 0.07 then 'camera' when l_returnflag = 'N' then 'lidar' else 'radar' end as modality,
          case when l_suppkey % 5 = 0 then null when l_suppkey % 5 = 1 then '' else concat('cal-', cast(l_suppkey % 7 as string)) end as calibration_id,
          case when l_partkey % 4 = 0 then null else concat('pose-', cast(l_partkey % 11 as string)) end as ego_pose_id,
          case when l_discount > 0.03 then 1600 end as width, case when l_discount > 0.02 then 900 end as height
        from lineitem""",
    "scene_calibrations": """
        select distinct cast(l_orderkey as string) as scene_id, concat('cal-', cast(l_suppkey % 7 as string)) as calibration_id, l_suppkey % 7 < 4 as has_intrinsic
        from lineitem where l_quantity > 15""",
    "scene_ego_poses": "select distinct cast(l_orderkey as string) as scene_id, concat('pose-', cast(l_partkey % 11 as string)) as ego_pose_id from lineitem where l_quantity > 10",
    "annotations": """
        select cast(vec_id as string) as annotation_id, concat('scene-', cast(cast(floor(vec_id / 250.0) as bigint) as string)) as scene_id,
          concat('sample-', cast(cast(floor(vec_id / 50.0) as bigint) as string)) as sample_id, concat('c', cast(label as string)) as category,
          EL(embedding, 1) as x, EL(embedding, 2) as y, EL(embedding, 3) as z, vec_id as gt_pos
        from embeddings where vec_id % 2 = 0""",
    "predictions": """
        select cast(vec_id as string) as prediction_id, concat('scene-', cast(cast(floor(vec_id / 250.0) as bigint) as string)) as scene_id,
          concat('sample-', cast(cast(floor(vec_id / 50.0) as bigint) as string)) as sample_id, concat('c', cast(label as string)) as category,
          EL(embedding, 1) as x, EL(embedding, 2) as y, EL(embedding, 3) as z,
          case vec_id % 10 when 1 then 'failed' when 3 then 'not_applicable' when 5 then null else 'succeeded' end as lifting_status, vec_id as pred_pos
        from embeddings where vec_id % 2 = 1""",
    "evaluation_runs": """
        select concat(cast(l_suppkey as string), '-', l_linestatus) as run_id, concat('m', cast(l_suppkey % 7 as string)) as model_id,
          cast(count(case when l_returnflag = 'A' then 1 end) as double) / count(*) as precision_value, count(*) as sample_count, max(US(l_shipdate)) as created_us
        from lineitem group by l_suppkey, l_linestatus""",
    "jobs": """
        select cast(event_id as string) as job_id,
          case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' when 'click' then 'running' when 'view' then 'pending' else 'queued' end as status,
          case event_id % 3 when 0 then 'job' when 1 then 'pipeline_run' else 'execution' end as kind, US(ts) as created_us, props as error_json
        from events""",
}
NEEDS = {name: sorted(set(re.findall(r"(?:from|join)\s+(\w+)", sql))) for name, sql in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``, lazily."""
    sql = re.sub(r"\bUS\((\w[\w.]*)\)", r"unix_micros(cast(\1 as timestamp))", VIEWS[name])
    sql = re.sub(r"\bEL\((\w+), (\d+)\)", r"cast(element_at(\1, \2) as double)", sql)
    sql = re.sub(r"\b(from|join)\s+(\w+)", r"\1 {\2}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in NEEDS[name]})


def ctes(*names: str) -> str:
    """The views as DuckDB common table expressions, comma-joined, to stand after ``with``."""
    out = []
    for name in names:
        sql = re.sub(r"\bUS\((\w[\w.]*)\)", r"epoch_us(\1)", VIEWS[name])
        sql = re.sub(r"\bEL\((\w+), (\d+)\)", r"cast(list_extract(\1, \2) as double)", sql)
        out.append(f"{name} as ({sql})")
    return ",\n".join(out)
