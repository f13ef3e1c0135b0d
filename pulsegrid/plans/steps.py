"""The nine imaging steps over acquisitions of one size, as DataFrame plans.

``frames`` is (acq_id, moment, t, y, x, v), one row per pixel; every artifact is keyed by
acq_id, so a batch of acquisitions is one plan.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import images as I
from ..operators import inference as N
from ..operators import masks as M
from ..operators import morphology, pulse
from .dag import Graph, Step, nested

KEY = ["acq_id"]


def setting(config: dict, path: str, default: Any) -> Any:
    value: Any = config
    for part in path.split("."):
        value = value.get(part, {}) if isinstance(value, dict) else {}
    return default if value in ({}, None) else value


def kept(config: dict, df: DataFrame) -> DataFrame:
    """An intermediate result that several artifacts start from."""
    return config["keep"](df) if "keep" in config else df


def shape(config: dict) -> tuple[int, int, int]:
    """Frames, rows and columns."""
    return tuple(config["shape"])


def rate(config: dict) -> float:
    return pulse.effective_rate(config["sampling_freq"], config["batch_stride"])


def predict(have: dict, config: dict, task: str) -> tuple[DataFrame, Any]:
    """Output (acq_id, shape, data) of the task's current model on its input images, and the model's description."""
    manager = config.get("models")
    if manager is None:
        raise ValueError(f"{task} needs a model: give the settings a model manager, or choose a method without one")
    spec, path = manager.resolve(task)
    missing = [c for c in spec.input_channels if c not in have]
    if missing:
        raise ValueError(f"{spec.name} takes {', '.join(missing)}, which {task} is not given")
    _, rows, columns = shape(config)
    images = N.channels(have, list(spec.input_channels), rows, columns)
    return kept(config, N.infer(images, spec, path, manager.backend(spec))), spec


def disc_centers(have: dict) -> DataFrame:
    """(acq_id, cx, cy), one row for each acquisition."""
    return have["optic_disc"].select("acq_id", F.col("center.x").alias("cx"), F.col("center.y").alias("cy"))


def flat_field(video: DataFrame, rows: int, columns: int, sigma: float, border: float = 0.15) -> DataFrame:
    """Divide a video (acq_id, t, y, x, v) by its Gaussian blur, keeping the energy inside the border."""
    unit = I.video_to_unit(video, "v", KEY)
    blurred = morphology.blur(unit, rows, columns, sigma)
    both = unit.join(blurred.withColumnRenamed("v", "blur"), ["acq_id", "t", "y", "x"])
    divided = I.flat_divide(both, out="corrected")
    restored = I.energy_restore(divided, "v", "corrected", rows, columns, border, KEY).withColumn("v", F.col("corrected"))
    return I.video_from_unit(restored).select("acq_id", "t", "y", "x", "v")


def read_moments(have, config):
    frames = have["frames"].withColumn("v", I.canonical(F.col("v").cast("double")))
    return {f"moment{m}": frames.where(F.col("moment") == m).select("acq_id", "t", "y", "x", "v") for m in range(3)}


def preprocess(have, config):
    _, rows, columns = shape(config)
    sigma = setting(config, "FlatFieldCorrection.GWRatio", 0.07) * columns
    out: dict[str, Any] = {}
    for m in range(3):
        video = flat_field(have[f"moment{m}"], rows, columns, sigma, setting(config, "FlatFieldCorrection.Border", 0.15))
        out[f"M{m}_ff_video"] = video
        out[f"M{m}_ff_image"] = I.to_uint8(I.temporal_mean(video, ["acq_id", "y", "x"]), "v", KEY)
    return out


def optic_disc(have, config):
    """The optic disc of each acquisition: acq_id, center struct<x, y>, axes struct<dx, dy>.

    By the detector's most confident box (given as ``detections``, or by the task's model), by
    the brightest pixel of M1 (OpticDiskDetectorMethod "moment1"), or the image's center
    (OpticDiskDetectorNet false); the last two have axes of 100.
    """
    _, rows, columns = shape(config)
    axes = F.struct(F.lit(100.0).alias("dx"), F.lit(100.0).alias("dy")).alias("axes")
    ids = have["M0_ff_image"].select("acq_id").distinct()
    middle = ids.select("acq_id", F.struct(F.lit(float(columns // 2)).alias("x"), F.lit(float(rows // 2)).alias("y")).alias("center"), axes)
    if not setting(config, "Mask.OpticDiskDetectorNet", setting(config, "OpticDiskDetectorNet", True)):
        return {"optic_disc": middle}
    if setting(config, "Mask.OpticDiskDetectorMethod", "") == "moment1":
        return {"optic_disc": I.argmax_center(have["M1_ff_image"], KEY).select("acq_id", "center", axes)}
    found = config.get("detections")
    if found is None:
        found = N.boxes(predict(have, config, "optic_disc_detection")[0])
    best = M.select_box(found, KEY).drop("box_id")
    # an acquisition without any box
    rest = middle.join(best.select("acq_id"), "acq_id", "left_anti")
    return {"optic_disc": best.unionByName(rest)}


def dark_ridges(have, config) -> DataFrame:
    """Pixels without dark ridges."""
    _, rows, columns = shape(config)
    return morphology.frangi_mask(have["M0_ff_image"].select("acq_id", "y", "x", F.col("v").cast("double").alias("v")), rows, columns)


def retinal_vessels(have, config):
    """Thresholded model output or the ridge filter, its largest component, inside the diaphragm; and the model's output."""
    _, rows, columns = shape(config)
    method = setting(config, "Mask.VesselSegmentationMethod", "AI")
    scores = have["M0_ff_image"].select("acq_id", "y", "x", F.lit(None).cast("double").alias("v")).where(F.lit(False))
    if method == "AI":
        scores = config.get("vessel_probability")
        if scores is None:
            scores = kept(config, N.pixels(predict(have, config, "retinal_vessel_segmentation")[0], rows, columns))
        raw = scores.where(M.over(F.col("v"))).select("acq_id", "y", "x")
    elif method == "frangi":
        raw = kept(config, dark_ridges(have, config))
    else:
        raise ValueError(f"unknown vessel segmentation {method!r}; there are AI and frangi")
    main = morphology.per_image(raw, rows, columns, "largest")
    inside = M.disk(rows, columns, setting(config, "Mask.DiaphragmRadius", 0.45))
    return {"retinal_vessel_mask": M.intersect(raw, main, ["acq_id", "y", "x"]).where(inside), "vessel_segmentation_logits": scores}


def choroidal_vessels(have, config):
    """What the ridge filter has besides the retinal vessels, within the diaphragm about the optic disc.

    The disc's share of the columns goes with the disk's rows, as observed.
    """
    _, rows, columns = shape(config)
    rest = M.subtract(dark_ridges(have, config), have["retinal_vessel_mask"], ["acq_id", "y", "x"])
    near = M.disk(rows, columns, setting(config, "Mask.DiaphragmRadius", 0.45), (F.col("cx") / columns, F.col("cy") / rows))
    return {"choroidal_vessel_mask": rest.join(disc_centers(have), "acq_id").where(near).select("acq_id", "y", "x")}


def pre_artery(have, config):
    length, rows, columns = shape(config)
    labels = kept(config, morphology.label_branches(have["retinal_vessel_mask"], rows, columns, have["optic_disc"]))
    signals = kept(config, pulse.branch_signals(have["M0_ff_video"], labels, length, rate(config)))
    judged = kept(config, pulse.pre_masks(signals, labels, length, rate(config)))
    marked = labels.join(judged.select("acq_id", "branch", "artery", "valid"), ["acq_id", "branch"])
    pick = lambda artery: marked.where(F.col("valid") & (F.col("artery") == artery)).select("acq_id", "y", "x")
    return {"labeled_vessels": labels, "branch_signals": signals, "corrected_signals": judged.select("acq_id", "branch", F.col("corrected").alias("x")), "pre_artery_mask": pick(True), "pre_vein_mask": pick(False)}


def pulse_of(video: DataFrame, mask: DataFrame) -> DataFrame:
    """Mask pulse of every acquisition: acq_id, x (array over time)."""
    count = mask.groupBy("acq_id").agg(F.count("*").alias("n"))
    sums = video.join(mask, ["acq_id", "y", "x"], "left_semi").groupBy("acq_id", "t").agg(F.sum("v").alias("v"))
    per = sums.join(count, "acq_id").withColumn("v", F.col("v") / F.col("n"))
    return per.groupBy("acq_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))


def temporal_cues(have, config):
    length, _, _ = shape(config)
    video, fs = have["M0_ff_video"], rate(config)
    raw = kept(config, pulse_of(video, have["pre_artery_mask"]))
    flags = raw.select("acq_id", F.posexplode(A.moving_outliers(F.col("x"))).alias("t", "flag"))
    fixed = kept(config, I.interpolate_flagged(video.join(flags, ["acq_id", "t"]), ["acq_id", "y", "x"]).drop("flag"))
    artery = kept(config, pulse_of(fixed, have["pre_artery_mask"]).withColumn("x", A.lowpass(F.col("x"), fs)))
    venous = kept(config, pulse_of(video, have["pre_vein_mask"]))
    choroid = kept(config, pulse_of(video, have["choroidal_vessel_mask"]))
    low = lambda df: df.withColumn("x", A.lowpass(F.col("x"), fs))
    signal = artery.select("acq_id", F.posexplode("x").alias("t", "s"))
    spread = fixed.groupBy("acq_id").agg(F.stddev_pop("v").alias("sv")).join(signal.groupBy("acq_id").agg(F.stddev_pop("s").alias("ss")), "acq_id")
    pairs = fixed.join(signal, ["acq_id", "t"]).groupBy("acq_id", "y", "x").agg(F.covar_pop("v", "s").alias("c"))
    correlation = pairs.join(spread, "acq_id").select("acq_id", "y", "x", F.try_divide(F.col("c"), F.col("sv") * F.col("ss")).alias("v"))
    marks = artery.select("acq_id", pulse.diasys_frames(F.col("x"), fs).alias("f"))
    marks = marks.select("acq_id", F.explode("f.systole").alias("t"), F.lit("s").alias("phase")).unionByName(marks.select("acq_id", F.explode("f.diastole").alias("t"), F.lit("d").alias("phase")))
    scaled = I.minmax(fixed.join(marks, ["acq_id", "t"]).groupBy("acq_id", "y", "x", "phase").agg(F.avg("v").alias("v")), "v", ["acq_id", "phase"])
    diff = scaled.groupBy("acq_id", "y", "x").agg((F.sum(F.when(F.col("phase") == "s", F.col("v"))) - F.sum(F.when(F.col("phase") == "d", F.col("v")))).alias("v"))
    return {
        "correlation": correlation,
        "diasys_image": I.minmax(diff, "v", KEY),
        "pre_arterial_pulse": raw,
        "pre_arterial_pulse_filtered": low(raw),
        "pre_arterial_pulse_interpolated": artery,
        "pre_venous_pulse": venous,
        "pre_venous_pulse_filtered": low(venous),
        "choroidal_pulse": choroid,
        "choroidal_pulse_filtered": low(choroid),
    }


def artery_vein(have, config):
    """Artery and vein masks: from given classes (0 to 3), by the task's model, or the pulse's own pre-masks.

    A model with argmax gives classes; of any other the first two channels over 0.5 count.
    """
    _, rows, columns = shape(config)
    method = setting(config, "AVSegmentationMethod", "AI")
    classes = config.get("av_class")
    if method == "pulse":
        return {"retinal_artery_mask": have["pre_artery_mask"], "retinal_vein_mask": have["pre_vein_mask"]}
    if method != "AI":
        raise ValueError(f"unknown artery and vein segmentation {method!r}; there are AI and pulse")
    if classes is None:
        out, spec = predict(have, config, "retinal_artery_vein_segmentation")
        if spec.output_activation != "argmax":
            over = [N.pixels(out, rows, columns, c).where(M.over(F.col("v"))).select("acq_id", "y", "x") for c in (0, 1)]
            return {"retinal_artery_mask": over[0], "retinal_vein_mask": over[1]}
        classes = N.pixels(out, rows, columns)
    artery, vein = M.artery_vein(F.col("v"))
    return {"retinal_artery_mask": classes.where(artery).select("acq_id", "y", "x"), "retinal_vein_mask": classes.where(vein).select("acq_id", "y", "x")}


def vessel_velocity(have, config):
    _, rows, columns = shape(config)
    at = ["acq_id", "t", "y", "x"]
    spread = kept(config, I.frms(have["M0_ff_video"], have["M2_ff_video"], at, ["acq_id", "t"]))
    vessels = M.union(have["retinal_artery_mask"], have["retinal_vein_mask"], ["acq_id", "y", "x"])
    wide = M.dilate(vessels, int(setting(config, "VelocityEstimation.LocalBackgroundDist", 2)), rows, columns, KEY)
    background = kept(config, morphology.inpaint(spread, wide, rows, columns))
    both = spread.join(background.withColumnRenamed("v", "b"), at)
    speed = both.select(*at, I.velocity(F.col("v"), F.col("b"), setting(config, "VelocityEstimation.Lambda", 852e-9), setting(config, "VelocityEstimation.Phi", 0.25)).alias("v"))
    speed = kept(config, speed)
    inside = M.section(rows, columns)
    out = {"retinal_vessel_velocity": speed, "velocity_map_avg": I.temporal_mean(speed, ["acq_id", "y", "x"]), "fRMS_avg": I.temporal_mean(spread, ["acq_id", "y", "x"]), "fRMS_bkg_avg": I.temporal_mean(background, ["acq_id", "y", "x"])}
    for kind in ("artery", "vein"):
        out[f"retinal_{kind}_velocity_signal"] = pulse_of(speed, have[f"retinal_{kind}_mask"].where(inside))
    return out


def arterial_waveform(have, config):
    """Filtered signal, beats of 128 points (a last row of zeros stands for the unfinished beat), beat marks."""
    marks = pulse.waveform_systole(F.col("x"), distance=int(setting(config, "Waveform.Distance", 40)))
    rows = kept(config, A.once(have["retinal_artery_velocity_signal"], "acq_id", A.binomial(F.col("x")).alias("filtered"), marks.alias("peaks")))
    made = A.once(rows, "acq_id", F.when(F.size("peaks") > 0, F.concat(A.beats(F.col("filtered"), F.col("peaks"), 128), F.array(F.array_repeat(F.lit(0.0), 128)))).otherwise(F.array().cast("array<array<double>>")).alias("beats"))
    gaps = F.transform(F.slice(F.col("peaks"), F.lit(2), F.greatest(F.size("peaks") - 1, F.lit(0))), lambda p, i: (p - F.get("peaks", i)) * config["batch_stride"] / float(config["sampling_freq"]))
    return {
        "retinal_artery_velocity_signal_filtered": rows.select("acq_id", F.col("filtered").alias("x")),
        "retinal_artery_velocity_signal_filtered_perbeat": made.select("acq_id", F.posexplode("beats").alias("beat", "x")),
        "beat_indices": rows.select("acq_id", F.posexplode("peaks").alias("beat", "t")),
        "time_per_beat": rows.select("acq_id", F.posexplode(gaps).alias("beat", "seconds")),
    }


def graph() -> Graph:
    """The shipped steps, in their order of declaration."""
    fs = ("sampling_freq", "batch_stride", "shape")
    return Graph([
        Step("read_moments", ("frames",), ("moment0", "moment1", "moment2"), read_moments),
        Step("preprocess", ("moment0", "moment1", "moment2"), tuple(f"M{m}_ff_{k}" for m in range(3) for k in ("video", "image")), preprocess, ("FlatFieldCorrection", "shape")),
        Step("optic_disc_detection", ("M0_ff_image", "M1_ff_image"), ("optic_disc",), optic_disc, ("Mask.OpticDiskDetectorNet", "Mask.OpticDiskDetectorMethod", "OpticDiskDetectorNet", "shape", "models")),
        Step("retinal_vessel_segmentation", ("M0_ff_image", "optic_disc"), ("retinal_vessel_mask", "vessel_segmentation_logits"), retinal_vessels, ("Mask", "shape", "models")),
        Step("choroidal_vessel_segmentation", ("M0_ff_image", "retinal_vessel_mask", "optic_disc"), ("choroidal_vessel_mask",), choroidal_vessels, ("Mask", "shape")),
        nested("pulse_analysis", [
            Step("pre_artery_mask", ("M0_ff_video", "retinal_vessel_mask", "optic_disc"), ("labeled_vessels", "branch_signals", "corrected_signals", "pre_artery_mask", "pre_vein_mask"), pre_artery, fs),
            Step("temporal_cues", ("M0_ff_video", "pre_artery_mask", "pre_vein_mask", "choroidal_vessel_mask"), ("correlation", "diasys_image", "pre_arterial_pulse", "pre_arterial_pulse_filtered", "pre_arterial_pulse_interpolated", "pre_venous_pulse", "pre_venous_pulse_filtered", "choroidal_pulse", "choroidal_pulse_filtered"), temporal_cues, fs),
        ]),
        Step("retinal_artery_vein_segmentation", ("M0_ff_video", "M0_ff_image", "correlation", "diasys_image", "pre_artery_mask", "pre_vein_mask"), ("retinal_artery_mask", "retinal_vein_mask"), artery_vein, ("AVSegmentationMethod", "shape", "models")),
        Step("retinal_vessel_velocity_estimator", ("M0_ff_video", "M2_ff_video", "retinal_artery_mask", "retinal_vein_mask", "optic_disc"), ("retinal_vessel_velocity", "velocity_map_avg", "fRMS_avg", "fRMS_bkg_avg", "retinal_artery_velocity_signal", "retinal_vein_velocity_signal"), vessel_velocity, ("VelocityEstimation", "shape")),
        Step("arterial_waveform_analysis", ("retinal_artery_velocity_signal",), ("retinal_artery_velocity_signal_filtered", "retinal_artery_velocity_signal_filtered_perbeat", "beat_indices", "time_per_beat"), arterial_waveform, ("sampling_freq", "batch_stride", "Waveform")),
    ])
