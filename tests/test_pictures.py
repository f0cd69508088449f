"""Picture kernels against loops over pixels."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vcspark import plans
from vcspark.functions import pictures

SF = "/root/testdata/sf0.001"


def grey(p, w, x, y):
    i = 3 * (y * w + x)
    return 299 * p[i] + 587 * p[i + 1] + 114 * p[i + 2]


def region(w, h, box):
    if box is None:
        return 0, 0, w, h
    x, y, bw, bh = box
    x0, y0 = min(max(0, math.floor(x * w)), w - 1), min(max(0, math.floor(y * h)), h - 1)
    return x0, y0, max(x0 + 1, min(w, math.ceil((x + bw) * w))), max(y0 + 1, min(h, math.ceil((y + bh) * h)))


def cell_means(value, area, rows, columns):
    x0, y0, x1, y1 = area
    out = []
    for r in range(rows):
        for c in range(columns):
            top, left = r * (y1 - y0) // rows, c * (x1 - x0) // columns
            bottom, right = max(top + 1, math.ceil((r + 1) * (y1 - y0) / rows)), max(left + 1, math.ceil((c + 1) * (x1 - x0) / columns))
            values = [value(x0 + x, y0 + y) for y in range(top, bottom) for x in range(left, right)]
            out.append(sum(values) / len(values))
    return out


def hexed(bits):
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def slow_average(p, w, h, box=None):
    cells = cell_means(lambda x, y: grey(p, w, x, y), region(w, h, box), 8, 8)
    return hexed([c > sum(cells) / 64 for c in cells])


def slow_difference(p, w, h):
    cells = cell_means(lambda x, y: grey(p, w, x, y), (0, 0, w, h), 8, 9)
    return hexed([cells[9 * r + c] > cells[9 * r + c + 1] for r in range(8) for c in range(8)])


def slow_sharpness(p, w, h, box):
    x0, y0, x1, y1 = region(w, h, box)
    steps = [abs(grey(p, w, x, y) - grey(p, w, x + dx, y + dy)) for y in range(y0, y1 - 1) for x in range(x0, x1 - 1) for dx, dy in ((1, 0), (0, 1))]
    return min(1.0, sum(steps) / 1000 / len(steps) / 32) if steps else 0.0


def slow_embedding(p, w, h):
    bits = int(slow_difference(p, w, h), 16)
    out = [((bits >> 2 * i & 3) - 1.5) / 1.5 for i in range(32)]
    small = [[math.floor(v + 0.5) for v in cell_means(lambda x, y: p[3 * (y * w + x) + c], (0, 0, w, h), 32, 32)] for c in range(3)]
    light = [(299 * r + 587 * g + 114 * b + 500) // 1000 for r, g, b in zip(*small)]
    for plane in (*small, light):
        out += [sum(min(7, v >> 5) == band for v in plane) / 1024 for band in range(8)]
    n = math.sqrt(sum(v * v for v in out))
    return [v / n for v in out]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    sizes = [(16, 16), (9, 8), (3, 5), (1, 1), (40, 23), (8, 8)]
    boxes = [None, (0.1, 0.2, 0.5, 0.5), (0.95, 0.95, 0.5, 0.5), (0.3, 0.3, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)]
    noise = [(rng.integers(0, 256, 3 * w * h, dtype=np.uint8).tobytes(), w, h, box) for w, h in sizes for box in boxes]
    return [*noise, (bytes([77]) * 192, 8, 8, None), (bytes(v for _ in range(16) for x in range(16) for v in (255 - 16 * x,) * 3), 16, 16, None)]


def test_kernels_equal_loops(spark, made):
    df = spark.createDataFrame([(p, w, h, box and dict(zip(("x", "y", "width", "height"), box))) for p, w, h, box in made], "p binary, w int, h int, box struct<x double, y double, width double, height double>")
    names = ["difference_hash", "average_hash", "picture_embedding"]
    rows = df.select("p", "w", "h", "box", *[getattr(pictures, n)("p", "w", "h").alias(n) for n in names], pictures.region_hash("p", "w", "h", "box").alias("part"), pictures.region_sharpness("p", "w", "h", "box").alias("sharp")).collect()
    assert len(rows) == len(made)
    for r in rows:
        p, box = bytes(r.p), r.box and tuple(r.box)
        assert r.difference_hash == slow_difference(p, r.w, r.h)
        assert r.average_hash == slow_average(p, r.w, r.h)
        assert r.part == slow_average(p, r.w, r.h, box)
        assert abs(r.sharp - slow_sharpness(p, r.w, r.h, box)) < 1e-9
        assert max(abs(a - b) for a, b in zip(r.picture_embedding, slow_embedding(p, r.w, r.h))) < 1e-12
    assert rows[-1].difference_hash == "f" * 16 and rows[-1].average_hash == "f0" * 8 and rows[-2].average_hash == "0" * 16


def test_pictures_of_no_use(spark):
    df = spark.createDataFrame([(None, 2, 2), (b"123", 2, 2), (b"", 0, 0), (bytes(12), None, 2)], "p binary, w int, h int")
    got = df.select(pictures.average_hash("p", "w", "h"), pictures.picture_embedding("p", "w", "h"), pictures.picture_difference("p", "w", "h", "p", "w", "h")).collect()
    assert all(v is None for r in got for v in r)
    two = spark.createDataFrame([(bytes(12), 2, 2, bytes(3), 1, 1), (bytes(12), 2, 2, b"\xff" * 12, 2, 2)], "a binary, aw int, ah int, b binary, bw int, bh int")
    assert [r[0] for r in two.select(pictures.picture_difference("a", "aw", "ah", "b", "bw", "bh")).collect()] == [1.0, 1.0]


def test_picture_queries_equal_loops(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}

    def picture(v, shift=0):
        return bytes(math.floor((max(-1.0, min(1.0, v[(p % 16 + p // 16 * 3 + 5 * c + shift) % len(v)])) + 1) * 127.5) for p in range(256) for c in range(3))

    hashes = {r.vec_id: r for r in plans.QUERIES["picture_hashes"](spark, SF).collect()}
    embedded = {r.vec_id: r.vector for r in plans.QUERIES["picture_embeddings"](spark, SF).collect()}
    assert set(hashes) == set(embedded) == set(vectors)
    for i in sorted(vectors)[::25]:
        p, q, r = picture(vectors[i]), picture(vectors[i], 1), hashes[i]
        box = (i % 5 / 10, i % 3 / 10, (i % 7 + 1) / 10, (i % 4 + 1) / 5)
        assert (r.dhash, r.ahash, r.box_hash) == (slow_difference(p, 16, 16), slow_average(p, 16, 16), slow_average(p, 16, 16, box))
        assert abs(r.box_sharpness - slow_sharpness(p, 16, 16, box)) < 1e-9 and abs(r.sharpness - slow_sharpness(p, 16, 16, None)) < 1e-9
        assert abs(r.moved - sum(abs(a - b) for a, b in zip(p, q)) / 255 / len(p)) < 1e-9
        assert r.moved_bits == (int(r.ahash, 16) ^ int(slow_average(q, 16, 16), 16)).bit_count()
        assert max(abs(a - b) for a, b in zip(embedded[i], slow_embedding(p, 16, 16))) < 1e-12
