"""Detections: classes, face scope, outcomes, and masks' targets."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from orbitframe.functions import raster

#: The class names of the detector's data set, in the order of their ids from 0.
COCO = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign",
    "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange", "broccoli", "carrot",
    "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote",
    "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier",
    "toothbrush",
)
#: The ids of each preset.
PRESETS = {"humans": (0,), "vehicles": tuple(range(2, 9)), "plants": (58,)}


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COCO)), "class_id int, class_name string")


def listed(text: Column) -> Column:
    """Trimmed, lower-case, non-blank entries of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def class_ids(names: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id) of every known name in a comma list; unknown names fall out. The class table has 80 rows."""
    e = names.select(id_col, F.explode(listed(F.col(text_col))).alias("class_name")).distinct()
    return e.join(F.broadcast(classes), "class_name").select(id_col, "class_id")


def targets(humans: Column, vehicles: Column, plants: Column, custom: Column) -> Column:
    """Distinct class ids of the presets and custom ids, rising; none at all means people."""
    ids = lambda flag, key: F.when(flag, F.array(*map(F.lit, PRESETS[key]))).otherwise(F.expr("cast(array() as array<int>)"))
    every = F.array_sort(F.array_distinct(F.concat(ids(humans, "humans"), ids(vehicles, "vehicles"), ids(plants, "plants"), F.coalesce(custom, F.expr("cast(array() as array<int>)")))))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(0)))


def face_scope(text: Column) -> Column:
    """Distinct face names of a comma list, or null (all faces) if it has none."""
    faces = F.array_sort(F.array_distinct(listed(text)))
    return F.when(F.size(faces) > 0, faces)


def in_scope(name: Column, scope: Column) -> Column:
    return scope.isNull() | F.array_contains(scope, F.lower(F.trim(name)))


def confident(detections: DataFrame, class_ids: list[int] | None, confidence: float) -> DataFrame:
    """Detections of the wanted classes (None: all) with at least the confidence."""
    found = detections.where(F.col("conf") >= confidence)
    return found if class_ids is None else found.where(F.col("class_id").isin([int(c) for c in class_ids]))


def without_detections(views: DataFrame, detections: DataFrame, on: list[str]) -> DataFrame:
    """Views without any detection; other views of the same frame stay."""
    return views.join(detections.select(*on).distinct(), on, "left_anti")


def outcomes(views: DataFrame, detections: DataFrame, on: list[str], mode: str, scope: Column | None = None) -> DataFrame:
    """views with ai_action: pass, drop, keep, mask or empty_mask.

    Views out of scope pass. skip_frame drops those with a detection and keeps others; generate_mask gives
    a mask, an empty one without detections that have masks; other modes pass all.
    """
    if mode not in ("skip_frame", "generate_mask"):
        return views.withColumn("ai_action", F.lit("pass"))
    hits = detections.groupBy(*on).agg(F.count("*").alias("_n"), F.count_if(F.col("has_mask")).alias("_masks"))
    v = views.join(hits, on, "left")
    n, masks = F.coalesce("_n", F.lit(0)), F.coalesce("_masks", F.lit(0))
    act = F.when(n > 0, "drop").otherwise("keep") if mode == "skip_frame" else F.when(masks > 0, "mask").otherwise("empty_mask")
    if scope is not None:
        act = F.when(scope, act).otherwise("pass")
    return v.withColumn("ai_action", act).drop("_n", "_masks")


class Detection(NamedTuple):
    """What a detector found: a class, its confidence, and the probability of each pixel, if it has a mask."""

    class_id: int
    conf: float
    mask: np.ndarray | None = None


class Detector(Protocol):
    """A model: what it finds in each image of a batch, of any class and confidence."""

    def detect(self, images: list[np.ndarray]) -> list[list[Detection]]: ...


#: Makers of detectors by name; a maker runs once in each task.
DETECTORS: dict[str, Callable[[], Detector]] = {}


def register(name: str, make: Callable[[], Detector]) -> None:
    DETECTORS[name] = make


def maker(name: str) -> Callable[[], Detector]:
    """The maker registered under a name, or that of ``module:function``; LookupError if there is none."""
    if name in DETECTORS:
        return DETECTORS[name]
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (AttributeError, ImportError, ValueError) as e:
        raise LookupError(f"no detector {name}: {e}") from e


def process_batch(detector: Detector | None, images: list[np.ndarray | None], mode: str, confidence: float, classes: list[int] | None, invert: bool = True, feather: bool = False) -> list[tuple[str, np.ndarray | None]]:
    """(action, mask) of each image: pass, drop, keep, or mask with the mask; see outcomes.

    Without a detector, for unreadable images and in other modes images pass. In mask mode an image in which nothing with a
    mask was found gets an empty one.
    """
    out: list[tuple[str, np.ndarray | None]] = [("pass", None)] * len(images)
    good = [i for i, x in enumerate(images) if x is not None]
    if detector is None or mode not in ("skip_frame", "generate_mask") or not good:
        return out
    for i, found in zip(good, detector.detect([images[i] for i in good])):
        found = [d for d in found if d.conf >= confidence and (classes is None or d.class_id in classes)]
        if mode == "skip_frame":
            out[i] = ("drop" if found else "keep", None)
            continue
        masks = [d.mask for d in found if d.mask is not None]
        h, w = images[i].shape[:2]
        out[i] = ("mask" if masks else "empty_mask", raster.detection_mask(np.stack(masks) if masks else np.zeros((0, h, w)), w, h, invert, feather))
    return out


def process_image(detector: Detector | None, image: np.ndarray | None, mode: str, confidence: float, classes: list[int] | None, invert: bool = True, feather: bool = False) -> tuple[str, np.ndarray | None]:
    """process_batch of one image."""
    return process_batch(detector, [image], mode, confidence, classes, invert, feather)[0]


def with_detector(views: DataFrame, make: Callable[[], Detector] | str | None, mode: str, confidence: float, classes: list[int] | None, invert: bool = True, feather: bool = False, image: str = "view_image", scope: str | None = None) -> DataFrame:
    """views with ai_action and mask (an image, or null) from a detector that each task makes once.

    make: a maker, the name of a registered one, or None. A maker that fails gives no detector, so views pass.
    ``scope``: a boolean column; views where it isn't true pass unseen. An Arrow batch is one batch of the detector.
    """
    make = DETECTORS.get(make) if isinstance(make, str) else make
    names = views.columns
    kind = raster._arrow(raster.IMAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            detector = make() if make else None
        except Exception:  # whatever a model's loader raises
            detector = None
        for b in batches:
            images = [None if x is None else raster.to_array(x["height"], x["width"], x["channels"], x["data"]) for x in b.column(names.index(image)).to_pylist()]
            if scope:
                images = [x if inside else None for x, inside in zip(images, b.column(names.index(scope)).to_pylist())]
            done = process_batch(detector, images, mode, confidence, classes, invert, feather)
            masks = [None if m is None else {"height": m.shape[0], "width": m.shape[1], "channels": 1, "data": m.tobytes()} for _, m in done]
            arrow = pa.schema([*zip(b.schema.names, b.schema.types), ("ai_action", pa.string()), ("mask", kind)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in done], pa.string()), pa.array(masks, kind)], schema=arrow)

    return views.mapInArrow(run, StructType([*views.schema.fields, *StructType.fromDDL(f"ai_action string, mask {raster.IMAGE}").fields]))


def _soft_mask(found: list | None, height: int, width: int, invert: bool, feather: bool) -> np.ndarray:
    soft = [np.asarray(x["prob"], float).reshape(x["height"], x["width"]) for x in found or ()]
    return raster.detection_mask(np.stack(soft) if soft else np.zeros((0, height, width)), width, height, invert, feather)


def with_sized_masks(rows: DataFrame, invert: bool = True, feather: bool = False, out: str = "mask") -> DataFrame:
    """rows (height, width, found array<struct<height,width,prob>>) with the mask of their detections; empty ones where nothing was found. No image is needed."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{out} {raster.IMAGE}").fields])
    names, kind = rows.columns, raster._arrow(raster.IMAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda c: b.column(names.index(c)).to_pylist()
            masks = [_soft_mask(found, h, w, invert, feather) for found, h, w in zip(at("found"), at("height"), at("width"))]
            made = [{"height": m.shape[0], "width": m.shape[1], "channels": 1, "data": m.tobytes()} for m in masks]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], schema=pa.schema([*zip(b.schema.names, b.schema.types), (out, kind)]))

    return rows.mapInArrow(run, schema)


def with_table_masks(views: DataFrame, detections: DataFrame, on: list[str], invert: bool = True, feather: bool = False, image: str = "view_image") -> DataFrame:
    """views (with ai_action of outcomes) with ``mask`` from a table of detections (on, height, width, prob array<float>).

    Views whose action is mask or empty_mask get one; all detections of a view are one mask. A detector gives an image a
    bounded number of detections, so a view's are gathered in its row.
    """
    found = detections.where("prob is not null").groupBy(*on).agg(F.collect_list(F.struct("height", "width", "prob")).alias("_found"))

    def mask(img, action, found):
        if img is None or action not in ("mask", "empty_mask"):
            return None
        return _soft_mask(found, *img.shape[:2], invert, feather)

    return raster.with_image_column(views.join(found, on, "left"), "mask", raster.IMAGE, mask, image, ("ai_action", "_found")).drop("_found")
