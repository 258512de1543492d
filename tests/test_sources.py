"""Schemas, code mapping, byte proof, writers, rectangles."""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.sources import assets as A


def test_codes_and_unknown_codes(spark):
    df = spark.createDataFrame([(1, 1, 4), (2, 4, 8), (9, 9, None)], "media_code int, source_code int, subtype_bits long")
    got = [tuple(r)[3:] for r in A.map_asset_codes(df).collect()]
    assert got == [("image", "userLibrary", True, False), ("video", "iTunesSynced", False, True), ("unknown", "other", False, False)]


def test_byte_proof_needs_the_primary_and_every_byte(spark):
    rows = [("a", 5, False, True, b"y"), ("a", 1, True, True, b"x"), ("b", 5, False, True, b"y"), ("c", 1, True, False, b"x"), ("d", 1, True, True, None)]
    df = spark.createDataFrame(rows, "key string, type_code long, is_primary boolean, readable boolean, bytes binary")
    got = {r.key: r.original_hash for r in A.original_hash(df).collect()}
    assert got == {"a": hashlib.sha256(b"1x5y").hexdigest(), "b": None, "c": None, "d": None}


def test_results_are_overwritten(spark, tmp_path):
    groups = spark.createDataFrame([("l1", "g1"), ("l2", "g2")], "library_id string, group_id string")
    for _ in range(2):
        A.write_result(groups, f"{tmp_path}/groups")
    assert spark.read.parquet(f"{tmp_path}/groups").count() == 2
    assert A.read_assets(spark, f"{tmp_path}/groups").count() == 2


def test_subject_rectangles(spark):
    rect = "struct<x:double,y:double,w:double,h:double>"
    face = lambda *v: dict(zip("xywh", v, strict=True))
    rows = [(1, [face(0.1, 0.1, 0.2, 0.2), face(0.5, 0.5, 0.4, 0.4)], None), (2, [], face(0.2, 0.3, 0.1, 0.1)), (3, [], None)]
    df = spark.createDataFrame(rows, f"k int, faces array<{rect}>, saliency {rect}")
    got = {r.k: [round(v, 6) for v in r.r] for r in df.select("k", S.subject_rect(F.col("faces"), F.col("saliency")).alias("r")).collect()}
    assert got == {1: [0.48, 0.08, 0.44, 0.44], 2: [0.2, 0.6, 0.1, 0.1], 3: [0.0, 0.0, 1.0, 1.0]}


def test_planes_of_each_tier(spark):
    n = 64
    checker = (np.indices((n, n)).sum(0) % 2) * 170.0 + 40
    ramp = np.tile(np.linspace(0, 255, n), (n, 1))
    shallow = ramp.copy()
    shallow[13:45, 19:51] = ((np.indices((n, n)).sum(0) % 2) * 190.0 + 30)[13:45, 19:51]
    whole, part = (0.0, 0.0, 1.0, 1.0), (0.3, 0.2, 0.4, 0.5)
    rows = [("sharp", checker, whole), ("soft", ramp, whole), ("white", np.full((n, n), 255.0), whole), ("black", np.zeros((n, n)), whole), ("shallow", shallow, part)]
    data = [(k, n, n, p.ravel().tolist(), r) for k, p, r in rows]
    df = spark.createDataFrame(data, "k string, w int, h int, p array<double>, subject struct<x:double,y:double,w:double,h:double>")
    df = df.withColumn("metrics", S.measure("w", "h", "p", "subject")).withColumn("q", S.classify_quality())
    got = {r.k: r.q.tier for r in df.collect()}
    assert got == {"sharp": "ok", "soft": "probablyBad", "white": "obviouslyBroken", "black": "obviouslyBroken", "shallow": "ok"}


def numpy_metrics(p, rect, face):
    """Written out pixel by pixel with shifted copies of the plane."""

    def variance(q):
        if min(q.shape) < 3:
            return 0.0
        c = q[1:-1, 1:-1]
        return float(np.var(c * 4 - q[1:-1, :-2] - q[1:-1, 2:] - q[:-2, 1:-1] - q[2:, 1:-1]))

    h, w = p.shape
    x, y, rw, rh = rect
    x0, y0, x1, y1 = (int(np.floor(v + 0.5)) for v in ((x + rw * 0.05) * w, (y + rh * 0.05) * h, (x + rw * 0.95) * w, (y + rh * 0.95) * h))
    return (variance(p[y0:y1, x0:x1]), variance(p), float(np.mean(p >= 252.5)), float(np.mean(p <= 2.5)), 1 - min(float(np.std(p)) / 255, 1), face)


def test_renditions_of_any_size(spark):
    g = np.random.default_rng(1)
    planes = {"large": g.integers(0, 256, (256, 256)), "wide": g.integers(0, 256, (40, 900)), "flat": np.full((200, 200), 90), "small": g.integers(0, 256, (2, 2)), "face": g.integers(0, 256, (256, 256))}
    faces = {"face": [(0.1, 0.1, 0.2, 0.2), (0.4, 0.3, 0.4, 0.5)]}
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.astype(np.uint8).tobytes()), faces.get(k), None, k == "wide") for k, p in planes.items()]
    rows += [("short", 10, 10, bytearray(b"abc"), [], None, False), ("missing", 10, 10, None, None, None, None), ("none", None, None, bytearray(b""), None, None, None)]
    got = {r.key: r for r in A.measure_renditions(spark.createDataFrame(rows, A.RENDITIONS)).collect()}
    for k, p in planes.items():
        # The face grown by 5 % a side, measured from the top.
        rect = (0.38, 1 - (0.3 - 0.025 + 0.55), 0.44, 0.55) if k == "face" else (0.0, 0.0, 1.0, 1.0)
        assert np.allclose(list(got[k].metrics), numpy_metrics(p.astype(float), rect, k == "face")), k
    assert all(got[k].metrics is None for k in ("short", "missing", "none"))
    assert {k: r.scored_from_stand_in for k, r in got.items()} == {"large": False, "face": False, "wide": True, "flat": False, "small": True, "short": True, "missing": True, "none": True}


def test_planes_as_arrays_are_measured_alike(spark):
    p = np.random.default_rng(2).integers(0, 256, (256, 256)).astype(float)
    df = spark.createDataFrame([(p.ravel().tolist(), 256, 256)], "p array<double>, w int, h int")
    assert np.isclose(df.select(S.laplacian_variance("p", "w", "h").alias("v")).first().v, numpy_metrics(p, (0, 0, 1, 1), False)[1])


def test_digests_of_equal_types_and_odd_rows(spark):
    rows = [("a", 2, False, True, b"z"), ("a", 1, True, True, b"b"), ("a", 1, False, True, b"a"), (None, 1, True, True, b"n"), ("e", 1, True, True, b""), ("u", 1, True, None, b"x"), ("a2", 10, False, True, b"t"), ("a2", 9, True, True, b"n")]
    df = spark.createDataFrame(rows, "key string, type_code long, is_primary boolean, readable boolean, bytes binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.key: r.original_hash for r in A.original_hash(df).collect()} == {"a": sha(b"1a1b2z"), None: sha(b"1n"), "e": sha(b"1"), "u": None, "a2": sha(b"9n10t")}
    assert A.original_hash(df.filter("false")).count() == 0


def peak_of_workers():
    """Largest resident size that a Python worker of this test run has had, in MB."""
    sizes = [0]
    for p in os.listdir("/proc"):
        try:
            with open(f"/proc/{p}/cmdline") as f, open(f"/proc/{p}/status") as s:
                if "pyspark.daemon" in f.read():
                    sizes += [int(x.split()[1]) / 1024 for x in s if x.startswith("VmHWM")]
        except OSError:
            pass
    return max(sizes)


def test_a_large_asset_is_digested_part_by_part(spark):
    part, n = 10 << 20, 20
    df = spark.range(n).select(F.lit("big").alias("key"), (F.col("id") + 1).alias("type_code"), (F.col("id") == 0).alias("is_primary"), F.lit(True).alias("readable"), F.encode(F.repeat(F.lit("x"), part), "UTF-8").alias("bytes"))
    want = hashlib.sha256()
    for i in range(n):
        want.update(str(i + 1).encode() + b"x" * part)
    assert [tuple(r) for r in A.original_hash(df).collect()] == [("big", want.hexdigest())]
    assert 0 < peak_of_workers() < 1000
