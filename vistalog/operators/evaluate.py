"""Evaluation of 3-D detections by centre distance: eligibility, greedy matching, metrics and run records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .folds import sorted_fold
from .steps import written
from .totals import with_totals

SUPPORTED = ("vehicle.car", "human.pedestrian", "movable_object.barrier")
#: Higher is better unless lower is named; by task.
METRICS = (
    ("detection", "precision", "higher"), ("detection", "recall", "higher"), ("detection", "f1", "higher"), ("detection", "mean_center_distance", "lower"),
    ("detection", "true_positives", "higher"), ("detection", "false_positives", "lower"), ("detection", "false_negatives", "lower"),
    ("scene_comparison", "geometry_error", "lower"), ("scene_comparison", "trajectory_error", "lower"), ("scene_comparison", "annotation_f1", "higher"), ("scene_comparison", "sensor_coverage", "higher"),
    ("auto_label", "precision", "higher"), ("auto_label", "recall", "higher"), ("auto_label", "f1", "higher"), ("auto_label", "labeling_coverage", "higher"),
)
EVALUATORS: dict[str, Callable[..., DataFrame]] = {}


def evaluator(name: str) -> Callable:
    """Register an evaluator, a function of DataFrames, by id."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        EVALUATORS[name] = f
        return f

    return add


def get_evaluator(name: str) -> Callable[..., DataFrame]:
    if name not in EVALUATORS:
        raise ValueError(f"unknown evaluator {name}; known: {', '.join(sorted(EVALUATORS))}")
    return EVALUATORS[name]


def metric_specs(spark) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "task string, metric string, direction string")


def scene_index(scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """Scenes with counts, a count of 0 giving way to that of the actual rows, and has_gt. ``samples`` has scene_id, sample_id and annotations."""
    actual = samples.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("annotations").alias("a"))
    counted = lambda c, n: F.coalesce(F.nullif(c, F.lit(0)), n, F.lit(0))
    out = scenes.join(actual, "scene_id", "left").withColumn("sample_count", counted("sample_count", "n")).withColumn("annotation_count", counted("annotation_count", "a")).drop("n", "a")
    return out.withColumn("has_gt", F.coalesce("has_ground_truth", F.lit(False)) | (F.col("annotation_count") > 0))


def eligibility(shards: DataFrame, index: DataFrame, sample_scenes: DataFrame) -> DataFrame:
    """Shards (scene_id, sample_id, payload_scene_id, payload_sample_id) with the scene that counts and eligibility.

    The payload's sample names the scene where the shard's is unknown, and the payload's scene wins over the shard's.
    """
    known = index.select("scene_id", "has_gt")
    by_sample = sample_scenes.select(F.col("sample_id").alias("payload_sample_id"), F.col("scene_id").alias("sample_scene_id"))
    joined = shards.join(known.select("scene_id", F.col("has_gt").alias("shard_gt")), "scene_id", "left").join(by_sample, "payload_sample_id", "left")
    scene = F.coalesce(F.when(F.col("payload_scene_id") != F.col("scene_id"), F.col("payload_scene_id")), F.when(F.col("shard_gt").isNotNull(), F.col("scene_id")), F.col("sample_scene_id"))
    joined = joined.withColumn("eval_scene_id", F.when((F.col("shard_gt") == F.lit(False)), F.col("scene_id")).otherwise(scene))
    joined = joined.join(known.select(F.col("scene_id").alias("eval_scene_id"), F.col("has_gt").alias("eval_gt")), "eval_scene_id", "left")
    state = F.when(F.col("eval_gt").isNull(), "sample_not_found_in_scene_index").when(~F.col("eval_gt"), "scene_has_no_ground_truth").otherwise("eligible")
    return joined.withColumn("eligibility", state).select(*shards.columns, "eval_scene_id", "eligibility")


def shard_warnings(shards: DataFrame) -> DataFrame:
    """Shards whose payload names another sample or scene."""
    one = lambda a, b, code: shards.where(F.col(a) != F.col(b)).select("sample_id", F.lit(code).alias("code"), F.col(a).alias("shard_value"), F.col(b).alias("payload_value"))
    return one("sample_id", "payload_sample_id", "shard_sample_id_mismatch").union(one("scene_id", "payload_scene_id", "shard_scene_id_mismatch"))


def supported(annotations: DataFrame, prefixes: Sequence[str] = SUPPORTED) -> DataFrame:
    """Ground truth of the supported categories, by prefix."""
    keep: Column = F.lit(False)
    for p in prefixes:
        keep = keep | F.startswith("category", F.lit(p))
    return annotations.where(keep)


def evaluable(predictions: DataFrame) -> DataFrame:
    """Predictions whose lifting did not fail; no status counts as good."""
    return predictions.where(~F.col("lifting_status").eqNullSafe("failed"))


def candidates(annotations: DataFrame, predictions: DataFrame, distance: float) -> DataFrame:
    """Pairs of one sample and category that are at most ``distance`` apart.

    Pairs meet by cells of that width on the ground: a box is copied to the nine cells around it, a prediction looks in its
    own, so pairs that are made are near those that are found, however many boxes a sample has.
    """
    cell = lambda c, d=0: F.floor(F.col(c) / max(distance, 1e-6)) + d
    placed = lambda df: df.where(F.greatest(F.abs("x"), F.abs("y")) < 1e12 * max(distance, 1e-6))
    around = F.explode(F.array(*[F.struct(cell("x", a).alias("_x"), cell("y", b).alias("_y")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    g = placed(annotations).select("sample_id", "category", "gt_pos", "annotation_id", F.struct("x", "y", "z").alias("g"), around.alias("_c")).select("*", "_c.*").drop("_c")
    p = placed(predictions).select("sample_id", "category", "pred_pos", "prediction_id", F.struct("x", "y", "z").alias("p"), cell("x").alias("_x"), cell("y").alias("_y"))
    square = lambda c: (F.col(f"p.{c}") - F.col(f"g.{c}")) * (F.col(f"p.{c}") - F.col(f"g.{c}"))
    pairs = p.join(g, ["sample_id", "category", "_x", "_y"]).withColumn("distance", F.sqrt(square("x") + square("y") + square("z")))
    return pairs.where(F.col("distance") <= distance).drop("p", "g", "_x", "_y")


def matches(annotations: DataFrame, predictions: DataFrame, distance: float = 2.0, rounds: int = 4) -> DataFrame:
    """Greedy matches: predictions in list order each take the nearest box of their sample and category not yet taken.

    Of equal distances the first box counts; a match is at most ``distance`` apart. A prediction whose nearest free box no
    earlier free prediction can take is sure of it, so all such are settled at once, in rounds whose number follows
    from chains of overlapping predictions, not from the size of a sample. Pairs that ``rounds`` leave open are settled by a
    fold over their sample and category in order. Pairs at infinite places, or beyond 1e12 distances, don't match. Runs jobs
    that write to the shared folder.
    """
    key, pred, box = ["sample_id", "category"], ["sample_id", "category", "pred_pos"], ["sample_id", "category", "gt_pos"]
    left = written(candidates(annotations, predictions, distance), "pairs")
    out = left.limit(0)
    for _ in range(rounds):
        nearest = F.min(F.struct("distance", "gt_pos")).over(Window.partitionBy(*pred))
        first = F.min("pred_pos").over(Window.partitionBy(*box))
        marked = left.withColumn("_near", nearest["gt_pos"]).withColumn("_first", first)
        sure = written(marked.where((F.col("_near") == F.col("gt_pos")) & (F.col("_first") == F.col("pred_pos"))).drop("_near", "_first"), "sure")
        out = out.unionByName(sure)
        left = written(left.join(sure.select(*pred), pred, "left_anti").join(sure.select(*box), box, "left_anti"), "pairs")
        if left.isEmpty():
            break
    else:
        out = out.unionByName(_folded(left, key))
    return out.select("sample_id", "category", "prediction_id", "annotation_id", F.round("distance", 6).alias("distance"))


def _folded(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """The greedy choice over each key in order."""

    def start():
        taken, done = set(), None

        def step(pred: int, gt: int) -> bool:
            nonlocal done
            if pred == done or gt in taken:
                return False
            taken.add(gt)
            done = pred
            return True

        return step

    return sorted_fold(pairs, key, ["pred_pos", "distance", "gt_pos"], ["pred_pos", "gt_pos"], start, "matched", "boolean").where("matched").drop("matched")


def _ratio(a: str, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))


def counts(annotations: DataFrame, predictions: DataFrame, matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp, fp, fn and the sum of match distances by the given columns, over all that appear on either side."""
    by = list(by)
    g = annotations.groupBy(*by).agg(F.count("*").alias("gt"))
    p = predictions.groupBy(*by).agg(F.count("*").alias("evaluable"))
    m = matched.groupBy(*by).agg(F.count("*").alias("tp"), F.round(F.sum("distance"), 6).alias("distance_sum"))
    out = g.join(p, by, "full").join(m, by, "left").fillna(0, ["gt", "evaluable", "tp"]).fillna(0.0, ["distance_sum"])
    return out.select(*by, "tp", (F.col("evaluable") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), "distance_sum")


def with_rates(counted: DataFrame) -> DataFrame:
    """precision, recall and mean distance, 0 where nothing is counted, to six decimals."""
    r = lambda c: F.round(c, 6)
    return counted.withColumn("precision", r(_ratio("tp", F.col("tp") + F.col("fp")))).withColumn("recall", r(_ratio("tp", F.col("tp") + F.col("fn")))).withColumn("mean_distance", r(_ratio("distance_sum", F.col("tp"))))


def run_totals(sample_metrics: DataFrame) -> DataFrame:
    """One row over the samples of center_distance()."""
    total = sample_metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "distance_sum")], F.count("*").alias("evaluated_samples"))
    return with_rates(total.withColumn("evaluable_predictions", F.col("tp") + F.col("fp")).withColumn("ground_truth", F.col("tp") + F.col("fn")))


@evaluator("center_distance")
def center_distance(annotations: DataFrame, predictions: DataFrame, distance: float = 2.0, prefixes: Sequence[str] = SUPPORTED, judged: DataFrame | None = None) -> DataFrame:
    """Metrics of each sample that has an eligible shard, once however many shards name it; without ``judged``, the
    result of eligibility(), of each sample that has a prediction."""
    if judged is None:
        samples = predictions.select("sample_id").distinct()
    else:
        samples = judged.where("eligibility = 'eligible'").select(F.col("payload_sample_id").alias("sample_id")).distinct()
    gt = supported(annotations, prefixes).join(samples, "sample_id", "left_semi")
    good = evaluable(predictions).join(samples, "sample_id", "left_semi")
    counted = counts(gt, good, matches(gt, good, distance), ["sample_id"])
    return with_rates(samples.join(counted, "sample_id", "left").fillna(0, ["tp", "fp", "fn"]).fillna(0.0, ["distance_sum"]))


def run_status(index: DataFrame, eligible: DataFrame, policy: str = "skip") -> DataFrame:
    """status and reason of a run, in one row: skipped, or with policy fail failed, without ground truth or anything evaluable."""
    if policy not in ("skip", "fail"):
        raise ValueError("policy must be skip or fail")
    gt = index.agg(F.count_if("has_gt").alias("with_gt"))
    n = eligible.where("eligibility = 'eligible'").agg(F.count("*").alias("eligible"))
    reason = F.when(F.col("with_gt") == 0, "no_ground_truth_in_dataset").when(F.col("eligible") == 0, "no_evaluable_samples")
    return with_totals(gt, n).select(F.when(reason.isNull(), "succeeded").otherwise("skipped" if policy == "skip" else "failed").alias("status"), reason.alias("reason"))


def run_record(sample_metrics: DataFrame, judged: DataFrame, listed: int = 50) -> DataFrame:
    """The run's primary metric with evaluated and skipped scenes: counts whole, ids of the first ``listed`` only."""
    total = run_totals(sample_metrics).select(F.lit("precision").alias("primary_metric"), F.col("precision").alias("primary_value"))
    state = judged.groupBy(F.coalesce("eval_scene_id", "scene_id").alias("scene_id")).agg(F.bool_or(F.col("eligibility") == "eligible").alias("evaluated"))

    def part(good: Column, name: str) -> DataFrame:
        own = state.where(good)
        ids = own.orderBy("scene_id").limit(listed).agg(F.sort_array(F.collect_list("scene_id")).alias(f"{name}_scene_ids"))
        return with_totals(own.agg(F.count("*").alias(f"{name}_scene_count")), ids)

    return with_totals(with_totals(total, part(F.col("evaluated"), "evaluated")), part(~F.col("evaluated"), "skipped"))


def label_quality(annotations: DataFrame, predictions: DataFrame, distance: float = 2.0) -> DataFrame:
    """Precision, recall, F1 and the share of samples with a label, in one row, of labels made automatically."""
    good = evaluable(predictions)
    by_class = counts(annotations, good, matches(annotations, good, distance), ["category"])
    total = with_rates(by_class.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "distance_sum")]))
    every = annotations.select("sample_id").union(predictions.select("sample_id")).agg(F.countDistinct("sample_id").alias("samples"))
    some = good.agg(F.countDistinct("sample_id").alias("labelled"))
    f1 = F.coalesce(F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6), F.lit(0.0))
    return with_totals(with_totals(total, every), some).select("precision", "recall", f1.alias("f1"), F.round(_ratio("labelled", F.col("samples")), 6).alias("labeling_coverage"))


def compare_scenes(left: DataFrame, right: DataFrame, distance: float = 2.0) -> DataFrame:
    """Per scene: mean distance of boxes with equal annotation_id, and the F1 of greedy matches between both sides."""
    a = left.select("scene_id", "annotation_id", F.struct("x", "y", "z").alias("a"))
    b = right.select("scene_id", "annotation_id", F.struct("x", "y", "z").alias("b"))
    square = lambda c: (F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}"))
    error = a.join(b, ["scene_id", "annotation_id"]).groupBy("scene_id").agg(F.round(F.avg(F.sqrt(square("x") + square("y") + square("z"))), 6).alias("geometry_error"))
    preds = right.select("scene_id", "sample_id", "category", "x", "y", "z", F.col("gt_pos").alias("pred_pos"), F.col("annotation_id").alias("prediction_id"))
    found = matches(left, preds, distance).join(left.select("annotation_id", "scene_id"), "annotation_id")
    counted = with_rates(counts(left, preds, found, ["scene_id"]))
    f1 = F.coalesce(F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6), F.lit(0.0))
    return counted.select("scene_id", f1.alias("annotation_f1")).join(error, "scene_id", "full")


def trajectory_errors(left: DataFrame, right: DataFrame, tolerance_us: int, bucket_us: int | None = None) -> DataFrame:
    """Per scene of ``left``: mean displacement of agents (agent_id) on the right, and how many agents were compared.

    Each left place (scene_id, agent_id, timestamp_us, pos, x, y, z) meets the agent's nearest one in time on the right,
    within ``tolerance_us``. Places are averaged to agents and agents to the scene; without any the error is null.
    """
    met = asof(left, right, ["scene_id", "agent_id"], "nearest", tolerance_us, bucket_us=bucket_us)
    square = lambda c: (F.col(c) - F.col(f"found.{c}")) * (F.col(c) - F.col(f"found.{c}"))
    apart = met.withColumn("_d", F.sqrt(square("x") + square("y") + square("z")))
    agents = apart.groupBy("scene_id", "agent_id").agg(F.avg("_d").alias("_d"))
    return agents.groupBy("scene_id").agg(F.round(F.avg("_d"), 6).alias("trajectory_error"), F.count("_d").alias("compared_agents"))


def sensor_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per scene of ``left`` (scene_id, sample_id, channel): the shares of its channels, and of the channels of its samples, on the right too."""
    side = lambda df, here, there: df.select("scene_id", "channel", "sample_id", F.lit(here).alias("_a"), F.lit(there).alias("_b"))
    seen = side(left, 1, 0).union(side(right, 0, 1)).groupBy("scene_id", "channel", "sample_id").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    channels = seen.groupBy("scene_id", "channel").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_a").alias("_n"), F.sum(F.col("_a") * F.col("_b")).alias("_both"))
    scenes = channels.groupBy("scene_id").agg(F.sum("_a").alias("_c"), F.sum(F.col("_a") * F.col("_b")).alias("_cb"), F.sum("_n").alias("_n"), F.sum("_both").alias("_both")).where("_c > 0")
    return scenes.select("scene_id", F.round(F.col("_cb") / F.col("_c"), 6).alias("channel_coverage"), F.round(F.col("_both") / F.col("_n"), 6).alias("frame_coverage"))
