"""Motion, strides, crops and checks of metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stride, least share of moving pixels, least area of a contour.
MOTION_PRESETS = {"fast": (30, 0.03, 800), "balanced": (10, 0.02, 500), "accurate": (5, 0.015, 300)}


def motion(contours: Column, pixels: Column, preset: str = "balanced") -> Column:
    """Struct of motion in a frame from its contours' areas: share, area, objects and whether it is motion."""
    _, least, smallest = MOTION_PRESETS[preset]
    big = F.filter(contours, lambda a: a >= smallest)
    total = F.aggregate(big, F.lit(0.0), lambda s, a: s + a)
    share = F.coalesce(F.try_divide(total, pixels.cast("double")), F.lit(0.0))
    return F.struct((share >= least).alias("has_motion"), share.alias("motion_percentage"), total.cast("long").alias("motion_area_pixels"), F.size(big).alias("num_moving_objects"))


def auto_stride(frames: Column, fps: Column, minutes: int = 15) -> Column:
    """Frames to step so that a video takes ``minutes`` at 150 frames a second; one frame a second at least is seen."""
    budget = 150 * 60 * minutes
    rate = F.when(fps > 0, fps).otherwise(25.0)
    return F.when(frames <= budget, F.lit(1).cast("long")).otherwise(F.greatest(F.least(F.floor(frames / budget), F.greatest(F.floor(rate), F.lit(1))), F.lit(1)).cast("long"))


def padded(box: list[Column], width: Column, height: Column, pad: int) -> list[Column]:
    """A crop with a margin, inside its picture."""
    return [F.greatest(box[0] - pad, F.lit(0)), F.greatest(box[1] - pad, F.lit(0)), F.least(box[2] + pad, width), F.least(box[3] + pad, height)]


def frame_index(stored: Column, position: Column, stride: Column) -> Column:
    """A frame's stored number, or its position times the stride."""
    return F.coalesce(stored, position * F.greatest(stride, F.lit(1)))


def metadata_flags(container: Column, frames: Column, fps: Column, size: Column, bit_rate: Column, declared: Column) -> Column:
    """Flags ``(check, severity, confidence)`` for a length, a bit rate or a number of frames that disagrees with the file."""
    computed = F.try_divide(frames, fps)
    off = F.abs(container - computed)
    actual = F.try_divide(size * 8, container)
    rate = F.try_divide(F.abs(actual - bit_rate), bit_rate)
    miss = F.abs(declared - frames)
    flag = lambda test, check, severity, sure: F.when(test, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.least(sure.cast("double"), F.lit(1.0)).alias("confidence")))
    all_flags = F.array(
        flag((container > 0) & (computed > 0) & (off > F.greatest(container * 0.02, F.lit(1.0))), "duration", "warning", F.try_divide(off, container)),
        flag((size > 0) & (container > 0) & (bit_rate > 0) & (rate > 0.15), "bit_rate", "info", rate),
        flag((declared > 0) & (frames > 0) & (miss > F.greatest(frames * 0.01, F.lit(5.0))), "frames", "warning", F.try_divide(miss, frames)),
    )
    return F.array_compact(all_flags)


def frame_seconds(index: Column, fps: Column) -> Column:
    """Seconds of a frame; null where the rate is null or 0."""
    return F.try_divide(index.cast("double"), fps.cast("double"))


def upscale(height: Column, least: int = 200) -> Column:
    """Whole factor by which a crop of ``height`` grows before it is read."""
    return F.greatest(F.lit(1), F.floor(F.lit(least) / F.greatest(height, F.lit(1)))).cast("int")


#: Parts of a box by rows and columns (from, to) that colours are taken from.
REGIONS = {"upper": (0.15, 0.45, 0.25, 0.75), "lower": (0.50, 0.80, 0.25, 0.75), "vehicle": (0.25, 0.75, 0.10, 0.90), "hair": (0.0, 0.15, 0.30, 0.70)}


def region(box: list[Column], name: str) -> list[Column]:
    """Corners of a part of a box, whole pixels."""
    x1, y1, x2, y2 = box
    top, bottom, left, right = REGIONS[name]
    return [F.floor(x1 + (x2 - x1) * left), F.floor(y1 + (y2 - y1) * top), F.floor(x1 + (x2 - x1) * right), F.floor(y1 + (y2 - y1) * bottom)]


def similarity_index(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, covariance: Column) -> Column:
    """Structural similarity of two 8-bit pictures from their statistics."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * mean_a * mean_b + c1) * (2 * covariance + c2) / ((mean_a * mean_a + mean_b * mean_b + c1) * (var_a + var_b + c2))
