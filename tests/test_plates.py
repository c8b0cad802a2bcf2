"""The grid of priors and plates of frames against plain loops."""

import math
import random

from veilspark.operators import plates as p


def grid():
    return [((c + 0.5) * step / 320, (r + 0.5) * step / 240, s / 320, s / 240) for step, sizes in ((8, (10, 16, 24)), (16, (32, 48)), (32, (64, 96)), (64, (128, 192, 256))) for r in range(240 // step) for c in range(320 // step) for s in sizes]


def cut(x, y, w, h, width, height):
    px, py = max(4, math.floor(w * 0.08 + 0.5)), max(4, math.floor(h * 0.08 + 0.5))
    left, top, right, low = max(0, math.floor(x) - px), max(0, math.floor(y) - py), min(width, math.ceil(x + w) + px), min(height, math.ceil(y + h) + py)
    return (left, top, right - left, low - top) if right - left >= 2 and low - top >= 2 else None


def share(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_priors(spark):
    got = [(r.cx, r.cy, r.w, r.h) for r in p.priors(spark).orderBy("prior").collect()]
    assert got == grid() and len(got) == 4385


def test_plates(spark):
    r, g = random.Random(3), grid()
    frames = [("a", 640, 480), ("b", 100, 900), ("c", 320, 240), ("none", 9, 9)]
    rows = []
    for key, _, _ in frames[:3]:
        near = r.randrange(len(g))
        for i in range(300):
            prior = (near + r.choice([0, 1, 2, 3, 120])) % len(g) if i % 2 else r.randrange(len(g) + 40)
            if (key, prior) not in {(q[0], q[1]) for q in rows}:
                rows.append((key, prior, [r.uniform(-6, 6) for _ in range(14)], [0.1, r.choice([0.7, 0.9, 0.95, 1.2])], r.choice([0.5, 0.9, 1.0, 1.3])))
    rows += [("a", 5, [0.0] * 13, [0.1, 1.0], 1.0), ("a", 6, None, [0.1, 1.0], 1.0), ("a", 7, [0.0] * 14, [1.0], 1.0), ("a", 8, [0.0] * 14, [0.0, -1.0], 1.0)]
    want = []
    for key, width, height in frames:
        found = []
        for k, prior, v, c, o in rows:
            if k == key and prior < len(g) and v and len(v) == 14 and len(c) == 2 and (score := math.sqrt(max(0, c[1]) * max(0, min(1, o)))) >= 0.8:
                cx, cy, w, h = g[prior]
                xs, ys = [(cx + v[i] * 0.1 * w) * 320 for i in (4, 6, 10, 12)], [(cy + v[i + 1] * 0.1 * h) * 240 for i in (4, 6, 10, 12)]
                if box := cut(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), 320, 240):
                    found.append((-score, prior, box))
        kept = []
        for s, _, box in sorted(found):
            if all(share(b, box) <= 0.3 for _, b in kept):
                kept.append((s, box))
        for s, (x, y, w, h) in kept:
            if box := cut(x * (width / 320), y * (height / 240), w * (width / 320), h * (height / 240), width, height):
                want.append((key, *box, min(1.0, -s)))
    df = spark.createDataFrame(rows, "f string, prior int, location array<double>, confidence array<double>, iou double")
    got = p.plates(df, spark.createDataFrame(frames, "f string, width int, height int"), "f").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
