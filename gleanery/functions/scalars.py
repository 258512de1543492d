"""Scalar functions: hashes, distances, thresholds, quality measures and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.config import US, NearConfig, QualityConfig

_LOW = 0xFFFFFFFF
# Reason texts; predicates look for "blown out", "black" and "clipped" in them.
ONE_COLOUR = "Nearly one colour: covered lens or accidental press"
BLOWN_OUT = "Almost entirely blown out"
BLACK = "Almost entirely black"
FACE_SOFT = "Face is out of focus"
SOFT = "Out of focus or motion-blurred"
CLIPPED = "Severely clipped exposure"


def fnv1a64_hex(text: Column) -> Column:
    """FNV-1a, 64 bits, over the UTF-8 bytes; two 32-bit limbs, since a long multiplication would overflow."""
    # A character per byte; splitting is linear, while a substring by place would be quadratic.
    octets = F.transform(F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(acc: Column, octet: Column) -> Column:
        x = acc["lo"].bitwiseXOR(octet)
        product = x * 435
        high = acc["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    pad = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(octets, start, step, lambda acc: F.concat(pad(acc["hi"]), pad(acc["lo"])))


def group_id(kind: Column, keys: Column) -> Column:
    return fnv1a64_hex(F.concat_ws("|", kind, F.array_join(F.array_sort(keys), "|")))


def content_hash(width: Column, height: Column, pixels: Column, stand_in: Column) -> Column:
    """SHA-256 of width and height (8 bytes, little-endian) and the pixels; null for stand-ins."""
    return F.when(~stand_in, F.sha2(F.concat(little64(width), little64(height), pixels), 256))


def little64(value: Column) -> Column:
    """8 bytes, least significant first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substr(digits, F.lit(i), F.lit(2)) for i in range(15, 0, -2)]))


def euclidean(a: Column, b: Column) -> Column:
    """Distance in double; null if a length is zero or differs."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def threshold_for_gap(gap_us: Column, config: NearConfig = NearConfig()) -> Column:
    out = F.lit(None).cast("double")
    for gap, limit in reversed(config.steps):
        out = F.when(gap_us < int(gap * US), F.lit(limit)).otherwise(out)
    return out


def pair_groupable(gap_us: Column, config: NearConfig = NearConfig()) -> Column:
    return (gap_us >= 0) & (gap_us < int(config.max_gap * US)) & threshold_for_gap(gap_us, config).isNotNull()


def time_gap_us(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def utc_year(us: Column) -> Column:
    """The session's time zone is UTC."""
    return F.year(F.timestamp_micros(us))


def stand_in_flag(width: Column, height: Column, fallback: Column, target: int = 256) -> Column:
    return fallback | (F.greatest(width, height) < target * 0.5)


def clip_fraction(samples: Column, high: float | None = None, low: float | None = None) -> Column:
    hit = (lambda x: x >= high) if high is not None else (lambda x: x <= low)
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, hit)) / F.size(samples)).otherwise(F.lit(0.0))


def uniformity(samples: Column) -> Column:
    n = F.size(samples)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = add(F.transform(samples, lambda x: x.cast("double"))) / n
    var = add(F.transform(samples, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean))) / n
    return F.when(n > 0, 1 - F.least(F.sqrt(var) / 255, F.lit(1.0))).otherwise(F.lit(1.0))


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5)) if x >= 0 else int(np.ceil(x - 0.5))


def subject_crop(plane: np.ndarray, rect: tuple[float, float, float, float]) -> np.ndarray:
    """The rectangle clamped to the frame, inset by 5 %, rounded; the whole plane if under 3 pixels are left."""
    h, w = plane.shape
    x, y = min(max(rect[0], 0), 1), min(max(rect[1], 0), 1)
    rw, rh = max(0.0, min(rect[2], 1 - x)), max(0.0, min(rect[3], 1 - y))
    x, y, rw, rh = x + rw * 0.05, y + rh * 0.05, rw * 0.9, rh * 0.9
    if rw <= 0 or rh <= 0:
        return plane
    x0, y0, x1, y1 = _half_up(x * w), _half_up(y * h), min(_half_up((x + rw) * w), w), min(_half_up((y + rh) * h), h)
    return plane[y0:y1, x0:x1] if x1 - x0 >= 3 and y1 - y0 >= 3 else plane


def sharpness(p: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian inside a plane; 0 under 3 pixels."""
    if min(p.shape) < 3:
        return 0.0
    inner = 4 * p[1:-1, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:] - p[:-2, 1:-1] - p[2:, 1:-1]
    return float(inner.var())


METRICS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("subject_sharpness", "global_sharpness", "clipped_highlights", "clipped_shadows", "frame_uniformity")]
    + [T.StructField("subject_is_face", T.BooleanType())]
)


def plane_metrics(p: np.ndarray, rect: tuple[float, float, float, float], face: bool) -> tuple:
    """The six metrics of a plane of values from 0 to 255, in the order of ``METRICS``."""
    if not p.size:
        return (0.0, 0.0, 0.0, 0.0, 1.0, face)
    return (sharpness(subject_crop(p, rect)), sharpness(p), float((p >= 252.5).mean()), float((p <= 2.5).mean()), 1 - min(float(p.std()) / 255, 1.0), face)


@F.pandas_udf(T.DoubleType())
def laplacian_variance(samples: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """``sharpness`` of planes of any size, given as arrays in row order."""
    return pd.Series([sharpness(np.asarray(s, float).reshape(h, w)) for s, w, h in zip(samples, width, height, strict=True)])


@F.pandas_udf(METRICS)
def measure(width: pd.Series, height: pd.Series, samples: pd.Series, subject: pd.DataFrame) -> pd.DataFrame:
    """The six metrics of a plane and its subject rectangle (x, y, w, h, and is_face if known), in one pass over the pixels."""
    faces = subject["is_face"] if "is_face" in subject else [False] * len(subject)
    rects = subject[["x", "y", "w", "h"]].itertuples(index=False)
    rows = [plane_metrics(np.asarray(s, float).reshape(h, w), tuple(rect), bool(face)) for w, h, s, rect, face in zip(width, height, samples, rects, faces, strict=True)]
    return pd.DataFrame(rows, columns=METRICS.names)


def classify_quality(m: str = "metrics", config: QualityConfig = QualityConfig()) -> Column:
    """struct<tier, reasons> of a metrics struct."""
    c = lambda name: F.col(f"{m}.{name}")
    one = lambda tier, text: F.struct(F.lit(tier).alias("tier"), F.array(F.lit(text)).alias("reasons"))
    focus = F.when(c("subject_sharpness") < config.bad_sharpness, F.when(c("subject_is_face"), F.lit(FACE_SOFT)).otherwise(F.lit(SOFT)))
    exposure = F.when((c("clipped_highlights") >= config.bad_clip) & (c("clipped_shadows") >= config.bad_clip), F.lit(CLIPPED))
    soft = F.array_compact(F.array(focus, exposure))
    return (
        F.when(c("frame_uniformity") >= config.broken_uniformity, one("obviouslyBroken", ONE_COLOUR))
        .when(c("clipped_highlights") >= config.broken_clip, one("obviouslyBroken", BLOWN_OUT))
        .when(c("clipped_shadows") >= config.broken_clip, one("obviouslyBroken", BLACK))
        .when(F.size(soft) > 0, F.struct(F.lit("probablyBad").alias("tier"), soft.alias("reasons")))
        .otherwise(F.struct(F.lit("ok").alias("tier"), F.array().cast("array<string>").alias("reasons")))
    )


def exposure_score(m: str = "quality.metrics") -> Column:
    return F.coalesce(1 - F.least(F.lit(1.0), F.col(f"{m}.clipped_highlights") + F.col(f"{m}.clipped_shadows")), F.lit(-1.0))


def confidence(stand_in: Column) -> Column:
    return F.when(stand_in, F.lit("low")).otherwise(F.lit("normal"))


def subject_rect(faces: Column, saliency: Column) -> Column:
    """The largest face grown by 5 % a side, else the salient area, else the frame; y is measured from the top."""
    area = lambda r: r["w"] * r["h"]
    largest = F.aggregate(faces, F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), lambda best, r: F.when(best.isNull() | (area(r) > area(best)), r).otherwise(best))
    clamp = lambda v, a, b: F.greatest(F.lit(a), F.least(v, b))

    def grown(r: Column) -> Column:
        x0, y0 = clamp(r["x"] - r["w"] * 0.05, 0.0, F.lit(1.0)), clamp(r["y"] - r["h"] * 0.05, 0.0, F.lit(1.0))
        x1, y1 = clamp(r["x"] + r["w"] * 1.05, 0.0, F.lit(1.0)), clamp(r["y"] + r["h"] * 1.05, 0.0, F.lit(1.0))
        return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))

    flipped = lambda r: F.struct(r["x"].alias("x"), (1 - r["y"] - r["h"]).alias("y"), r["w"].alias("w"), r["h"].alias("h"))
    whole = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    return F.when(largest.isNotNull(), flipped(grown(largest))).when(saliency.isNotNull(), flipped(saliency)).otherwise(whole)


def headline(kind: Column, n: Column, soft: Column, label: Column, any_flagged: Column) -> Column:
    """A group's one-line text; ``label`` is a year or a reason."""
    maybe = F.when(soft > 0, F.concat(F.lit(", "), soft.cast("string"), F.lit(" may be soft"))).otherwise(F.lit(""))
    count = n.cast("string")
    return (
        F.when(kind == "exactDuplicate", F.concat(count, F.lit(" copies of one photo")))
        .when(kind == "expiredUtility", F.concat(count, F.when(n == 1, F.lit(" screen capture, ")).otherwise(F.lit(" screen captures, ")), label))
        .when(kind == "burst", F.concat(F.lit("Burst of "), count, maybe))
        .when(kind == "bracket", F.concat(F.lit("Bracket of "), count, F.lit(", keep all")))
        .when(kind == "nearDuplicate", F.concat(count, F.lit(" near-identical shots"), maybe))
        .when(kind == "versions", F.when(any_flagged, F.lit("Edited version, the original can go")).otherwise(F.lit("Original and edited version")))
        .otherwise(label)
    )


def commit_text(n: Column, size: Column, situation: Column) -> Column:
    """What a commit would do, in words."""
    noun = F.when(n == 1, F.lit("item")).otherwise(F.lit("items"))
    gain = F.when(situation == "optimising", F.lit("frees cloud space")).when(situation == "fullCopies", F.lit("frees device space")).otherwise(F.lit("space gain unknown"))
    return F.concat_ws(" ", n.cast("string"), noun, F.concat(size.cast("string"), F.lit(" bytes:")), gain)


def session_text(n: Column, last_us: Column, now_us: Column) -> Column:
    """How much an earlier session reviewed, and how long ago; null without one."""
    age = F.floor((now_us - last_us) / (60 * US))
    noun = F.when(n == 1, F.lit("photo")).otherwise(F.lit("photos"))
    ago = F.when(age < 60, F.concat(age.cast("string"), F.lit(" min"))).when(age < 1440, F.concat(F.floor(age / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(age / 1440).cast("string"), F.lit(" d")))
    return F.concat(F.lit("Earlier session: "), n.cast("string"), F.lit(" "), noun, F.lit(" decided, "), ago, F.lit(" ago"))
