"""Lifting 2-D detections to 3-D boxes with lidar points: frustum filter, clustering and box fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import forward, rotation, yaw_quaternion

MIN_FRUSTUM_POINTS = 3


def scaled_boxes(detections: DataFrame, max_image_size: int = 1333) -> DataFrame:
    """Boxes x1, y1, x2, y2 of the resized image back at the size of the original, which width and height give."""
    scale = F.least(max_image_size / F.greatest("width", "height"), F.lit(1.0))
    return detections.select("*", *[(F.col(c) / scale).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])


def liftable(detections: DataFrame) -> DataFrame:
    """Detections for which calibrations, pose, intrinsic and image size are all known."""
    needs = ("camera_rotation", "camera_translation", "lidar_rotation", "lidar_translation", "ego_rotation", "ego_translation", "intrinsic", "width", "height")
    return detections.dropna(subset=list(needs))


_SENSORS = ("camera_rotation", "camera_translation", "lidar_rotation", "lidar_translation", "ego_rotation", "ego_translation", "intrinsic")


def projected(views: DataFrame, points: DataFrame) -> DataFrame:
    """view, point_pos, ego coordinates ex, ey, ez and image place u, v of the points that a view's camera can see.

    ``views`` (view, lidar_frame_id and sensor columns) meet ``points`` (frame_id, point_pos, x, y, z) on the lidar frame;
    a point is seen if it is over 0.1 in front of the camera and above the ground.
    """
    # Matrices are made once a view, below the join.
    turn = {f"{n}{i}{j}": c for n, q in (("l", "lidar_rotation"), ("c", "camera_rotation")) for i, row in enumerate(rotation(F.col(q))) for j, c in enumerate(row)}
    move = {f"{n}{i}": F.element_at(q, i + 1) for n, q in (("lt", "lidar_translation"), ("ct", "camera_translation")) for i in range(3)}
    lens = {f"k{i}{j}": F.element_at(F.element_at("intrinsic", i + 1), j + 1) for i in range(3) for j in range(3)}
    known = views.select("view", F.col("lidar_frame_id").alias("frame_id"), *[c.alias(n) for n, c in {**turn, **move, **lens}.items()])
    joined = known.join(points, "frame_id")
    dot = lambda m, v: sum((F.col(a) * F.col(b) for a, b in zip(m[1:], v[1:], strict=True)), F.col(m[0]) * F.col(v[0]))
    joined = joined.withColumns({f"e{x}": dot([f"l{i}{j}" for j in range(3)], "xyz") + F.col(f"lt{i}") for i, x in enumerate("xyz")})
    joined = joined.withColumns({f"d{i}": F.col(f"e{x}") - F.col(f"ct{i}") for i, x in enumerate("xyz")})
    seen = joined.withColumns({f"c{x}": dot([f"c{j}{i}" for j in range(3)], ["d0", "d1", "d2"]) for i, x in enumerate("xyz")}).where("cz > 0.1 and ez > 0")
    k = lambda r: dot([f"k{r}{j}" for j in range(3)], ["cx", "cy", "cz"])
    return seen.select("view", "point_pos", "ex", "ey", "ez", (k(0) / k(2)).alias("u"), (k(1) / k(2)).alias("v"))


def frustum_points(detections: DataFrame, points: DataFrame, cell: int = 64) -> DataFrame:
    """Points in each detection's frustum, in ego coordinates ex, ey, ez, for detections that have enough of them.

    Detections of one lidar frame and the same sensors are a view, and points are projected once a view. Boxes meet the
    projected points by image cells of ``cell`` pixels: a box is listed in the cells that it overlaps, a point is in one, so
    pairs that are made are near those inside.
    """
    boxes = scaled_boxes(liftable(detections)) if "bx1" not in detections.columns else liftable(detections)
    sensors = ["lidar_frame_id", *_SENSORS]
    boxes = boxes.withColumn("view", F.sha2(F.to_json(F.struct(*sensors)), 256))
    views = boxes.groupBy("view").agg(*[F.first(c).alias(c) for c in sensors])
    # Boxes of a view bound the places where a point can be of use; a box has at most 128 cells a side.
    bounds = boxes.groupBy("view").agg(F.min("bx1").alias("_x1"), F.max("bx2").alias("_x2"), F.min("by1").alias("_y1"), F.max("by2").alias("_y2"))
    bounds = bounds.withColumn("_cell", F.greatest(F.lit(float(cell)), (F.col("_x2") - F.col("_x1")) / 128, (F.col("_y2") - F.col("_y1")) / 128))
    at = lambda c: F.floor(F.col(c) / F.col("_cell"))
    span = lambda a, b: F.explode(F.when(F.col(a) <= F.col(b), F.sequence(at(a), at(b))))
    listed = boxes.select("detection_id", "view", "bx1", "bx2", "by1", "by2").join(bounds.select("view", "_cell"), "view").select("*", span("bx1", "bx2").alias("_u"))
    listed = listed.select("detection_id", "view", "bx1", "bx2", "by1", "by2", "_u", span("by1", "by2").alias("_v"))
    seen = projected(views, points).join(bounds, "view").where(F.col("u").between(F.col("_x1"), F.col("_x2")) & F.col("v").between(F.col("_y1"), F.col("_y2")))
    seen = seen.select("view", "point_pos", "ex", "ey", "ez", "u", "v", at("u").alias("_u"), at("v").alias("_v"))
    inside = seen.join(listed, ["view", "_u", "_v"]).where(F.col("u").between(F.col("bx1"), F.col("bx2")) & F.col("v").between(F.col("by1"), F.col("by2")))
    enough = inside.groupBy("detection_id").agg(F.count("*").alias("frustum_point_count")).where(F.col("frustum_point_count") >= MIN_FRUSTUM_POINTS)
    kept = inside.select("detection_id", "point_pos", "ex", "ey", "ez").join(enough, "detection_id")
    return kept.join(boxes.select("detection_id", "ego_rotation", "ego_translation"), "detection_id").select("detection_id", "point_pos", "ex", "ey", "ez", "ego_rotation", "ego_translation", "frustum_point_count")


def _neighbours(points: np.ndarray, eps: float) -> list[np.ndarray]:
    """Indexes of the points within ``eps`` of each point; many points are looked up in a grid of cells of that width."""
    n = len(points)
    if n <= 64:
        close = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2) <= eps * eps
        return [np.flatnonzero(r) for r in close]
    cells: dict[tuple[int, int, int], list[int]] = {}
    at = [tuple(c) for c in np.floor(points / eps).astype(np.int64).tolist()]
    for i, c in enumerate(at):
        cells.setdefault(c, []).append(i)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for (x, y, z), own in cells.items():
        around = np.array(sorted(j for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for j in cells.get((x + a, y + b, z + c), ())))
        for i in own:
            out[i] = around[((points[around] - points[i]) ** 2).sum(1) <= eps * eps]
    return out


def largest_cluster(points: np.ndarray, eps: float = 0.5, min_samples: int = 3) -> np.ndarray:
    """Mask of the largest density cluster, the first of equal ones; all points if there is none.

    A core point has ``min_samples`` points within ``eps``, itself included; a cluster is what core points reach.
    """
    n = len(points)
    near = _neighbours(points, eps)
    core = np.array([len(x) >= min_samples for x in near], bool)
    label, found = np.full(n, -1), 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        label[i], todo = found, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = found
                    if core[j]:
                        todo.append(j)
        found += 1
    if not found:
        return np.ones(n, bool)
    return label == np.bincount(label[label >= 0]).argmax()


def clustered(frustum: DataFrame, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """The frustum points of each detection's largest cluster.

    Rows are partitioned by detection and sorted, so a task holds a batch and one detection's points, which one lidar
    sweep bounds, and detections are handled many a batch.
    """

    def keep(part: pa.Table) -> pa.Table:
        ids = part.column("detection_id").to_numpy(zero_copy_only=False)
        xyz = np.stack([part.column(c).to_numpy() for c in ("ex", "ey", "ez")], axis=1)
        starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        masks = [largest_cluster(xyz[a:b], eps, min_samples) for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True)]
        return part.filter(pa.array(np.concatenate(masks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            ids = rows.column("detection_id").to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
            held = rows.slice(last)
            if last:
                yield from keep(rows.slice(0, last).combine_chunks()).to_batches()
        if held is not None:
            yield from keep(held.combine_chunks()).to_batches()

    return frustum.repartition("detection_id").sortWithinPartitions("detection_id", "point_pos").mapInArrow(run, frustum.schema)


def boxes(points: DataFrame) -> DataFrame:
    """A 3-D box of each detection's points: centre in global coordinates, size, and heading along the main axis of x and y."""
    fit = points.groupBy("detection_id").agg(
        *[F.avg(c).alias(f"m{c}") for c in ("ex", "ey", "ez")], *[(F.max(c) - F.min(c)).alias(f"s{c}") for c in ("ex", "ey", "ez")],
        F.covar_pop("ex", "ey").alias("cov"), F.var_pop("ex").alias("vx"), F.var_pop("ey").alias("vy"),
        F.count("*").alias("cluster_point_count"), F.first("frustum_point_count").alias("frustum_point_count"), F.first("ego_rotation").alias("r"), F.first("ego_translation").alias("t"),
    )
    centre = forward(F.col("r"), F.col("t"), [F.col("mex"), F.col("mey"), F.col("mez")])
    yaw = 0.5 * F.atan2(2 * F.col("cov"), F.col("vx") - F.col("vy"))
    return fit.select("detection_id", F.array(*centre).alias("translation"), F.array("sex", "sey", "sez").alias("size"), yaw_quaternion(yaw).alias("rotation"), yaw.alias("yaw"), "cluster_point_count", "frustum_point_count")


def prediction_records(detections: DataFrame, lifted: DataFrame) -> DataFrame:
    """A prediction for each detection (detection_id, sample_id, det_pos, category, score, lift_failed), lifted or with a placeholder box."""
    ok = F.col("translation").isNotNull()
    zero = lambda *v: F.array(*[F.lit(x) for x in v])
    status = F.when(F.coalesce("lift_failed", F.lit(False)), "failed").when(ok, "succeeded").otherwise("not_applicable")
    joined = detections.join(lifted, "detection_id", "left")
    return joined.select(
        F.format_string("%s-gdino-%04d", "sample_id", "det_pos").alias("prediction_id"), "sample_id", F.col("det_pos").alias("pred_pos"), "category", "score",
        F.coalesce("translation", zero(0.0, 0.0, 0.0)).alias("translation"), F.coalesce("size", zero(1.0, 1.0, 1.0)).alias("size"), F.coalesce("rotation", zero(1.0, 0.0, 0.0, 0.0)).alias("rotation"),
        F.when(ok, "frustum_lidar").otherwise("none").alias("lifting_method"), status.alias("lifting_status"), "cluster_point_count",
    )
