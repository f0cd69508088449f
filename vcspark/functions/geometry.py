"""Boxes as structs (x, y, width, height) in parts of the frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in (("x", x), ("y", y), ("width", width), ("height", height))])


def valid_box(b: Column) -> Column:
    ok = (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0) & (b["x"] + b["width"] <= 1.001) & (b["y"] + b["height"] <= 1.001)
    return F.coalesce(ok, F.lit(False))


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def oversized(b: Column, most: float = 0.85) -> Column:
    return area(b) > most


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return F.when(inter <= 0, 0.0).otherwise(F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0)))


def clamped(b: Column) -> Column:
    """The part of a box that lies within the frame."""
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x, y = cut(b["x"]), cut(b["y"])
    return box(x, y, cut(b["x"] + b["width"]) - x, cut(b["y"] + b["height"]) - y)


def padded(b: Column, part: float) -> Column:
    """A box grown by ``part`` of its size on each side, within the frame."""
    return clamped(box(b["x"] - b["width"] * part, b["y"] - b["height"] * part, b["width"] * (1 + 2 * part), b["height"] * (1 + 2 * part)))


def fitted(b: Column, frame_width: int, frame_height: int, width: int, height: int, cover: Column) -> Column:
    """A box of a frame in pixels of an element that shows it whole, or (``cover``) fills itself with it."""
    across, down = width / frame_width, height / frame_height
    scale = F.when(cover, max(across, down)).otherwise(min(across, down))
    w, h = frame_width * scale, frame_height * scale
    return box((width - w) / 2 + b["x"] * w, (height - h) / 2 + b["y"] * h, b["width"] * w, b["height"] * h)


def searchable(b: Column, least_side: float, least_area: float) -> Column:
    return valid_box(b) & (F.least(b["width"], b["height"]) >= least_side) & (area(b) >= least_area)


def covers_frame(b: Column, least: float = 0.7) -> Column:
    return F.coalesce(area(b) >= least, F.lit(False))


# Weights of crop quality, and width to height of products seen from the front, by slot.
QUALITY_WEIGHTS = {"sharpness": 0.2, "resolution": 0.15, "visibility": 0.2, "low_occlusion": 0.15, "frontal_view": 0.1, "logo_visibility": 0.1, "detector_confidence": 0.1}
FRONT_ASPECT = {"upper": 0.95, "lower": 0.55, "full_body": 0.45, "footwear": 1.3, "bag": 1.0, "headwear": 1.2, "accessory": 1.0}


def _unit(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def crop_quality(b: Column, sharpness: Column, slot: Column, logo: Column, confidence: Column, frame_width: int = 1280, frame_height: int = 720) -> Column:
    """A struct of seven signals and their weighted ``score``; without a box those of the box are 0 (0.5: frontal view)."""
    edge = 0.005
    touching = sum(((c).cast("int") for c in (b["x"] <= edge, b["y"] <= edge, b["x"] + b["width"] >= 1 - edge, b["y"] + b["height"] >= 1 - edge)), F.lit(0))
    expected = F.try_element_at(F.create_map(*[F.lit(v) for kv in FRONT_ASPECT.items() for v in kv]), slot)
    aspect = F.try_divide(b["width"], b["height"])
    signals = {
        "sharpness": _unit(sharpness),
        "resolution": _unit(F.least(b["width"] * frame_width, b["height"] * frame_height) / 224),
        "visibility": _unit(_unit(b["width"]) * _unit(b["height"]) / 0.35),
        "low_occlusion": F.when(b.isNull(), 0.0).otherwise(_unit(1 - touching * 0.3)),
        "frontal_view": F.coalesce(_unit_or_null(F.least(expected, aspect) / F.greatest(expected, aspect)), F.lit(0.5)),
        "logo_visibility": F.when(logo, 1.0).otherwise(0.3),
        "detector_confidence": _unit(confidence),
    }
    score = sum((signals[k] * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in signals.items()], _unit(score).alias("score"))


def _unit_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), _unit(x))
