"""Findings of real kinds: counts, merging, bridges against a plain loop, filter graphs."""

import math
import random

from veilspark.operators import media as m


def finding(stream, kind, value, start, end, box=(0, 0, 0, 0), confidence=0.5, rule="R", context=""):
    return (stream, kind, rule, value, start, end, *box, confidence, "label", context)


def test_counts_and_merging(spark):
    rows = [
        finding(0, "AUDIO", "", 0, 100, confidence=0.2), finding(0, "AUDIO", "x", 900, 1000, confidence=0.9, context="said"), finding(0, "AUDIO", "y", 1100, 1200),
        finding(0, "AUDIO", "z", 2001, 2100), finding(1, "AUDIO", "q", 900, 1000), finding(0, "SUBTITLE", "s", 0, 5000), finding(0, "SUBTITLE", "t", 100, 200, rule="S"),
        finding(0, "FACE", "", 0, 100, (1, 1, 5, 5)), finding(0, "FACE", "", 50, 150, (1, 1, 5, 5)), finding(0, "QR_CODE", "u", 0, 100, (9, 9, 5, 5)), finding(0, "OCR_TEXT", "w", 0, 100, (9, 9, 5, 5)),
    ]
    df = spark.createDataFrame(rows, m.FINDING)
    got = m.finding_counts(df).first()
    assert (got.audio, got.visual, got.subtitle) == (5, 4, 2)
    for buckets in (1, 6):
        merged = sorted((r.stream, r.kind, r.rule_id, r.value, r.start_ms, r.end_ms, r.confidence, r.context, r.n) for r in m.merged_findings(df, buckets=buckets).collect())
        assert merged == [
            (0, "AUDIO", "R", "x", 0, 1200, 0.9, "said", 3), (0, "AUDIO", "R", "z", 2001, 2100, 0.5, "", 1), (0, "FACE", "R", "", 0, 100, 0.5, "", 1), (0, "FACE", "R", "", 50, 150, 0.5, "", 1),
            (0, "OCR_TEXT", "R", "w", 0, 100, 0.5, "", 1), (0, "QR_CODE", "R", "u", 0, 100, 0.5, "", 1), (0, "SUBTITLE", "R", "s", 0, 5000, 0.5, "", 1), (0, "SUBTITLE", "S", "t", 100, 200, 0.5, "", 1), (1, "AUDIO", "R", "q", 900, 1000, 0.5, "", 1),
        ]


def test_known_bridges(spark):
    at = lambda *x: spark.createDataFrame([finding(s, "FACE", "", a, b, box, 0.9) for s, a, b, box in x], m.FINDING)
    one = m.bridges(at((0, 900, 1100, (10, 10, 30, 30)), (0, 1900, 2100, (100, 20, 30, 30))), 1.0).collect()
    assert [(r.kind, r.start_ms, r.end_ms) for r in one] == [("FACE", 1000, 2000)] and one[0].x <= 10 and one[0].x + one[0].w >= 130
    assert m.bridges(at((0, 900, 1100, (10, 10, 20, 20)), (0, 1900, 2100, (500, 400, 20, 20)), (1, 1900, 2100, (20, 20, 20, 20))), 1.0).collect() == []
    assert m.bridges(at((0, 900, 1100, (10, 10, 30, 30)), (0, 900, 1100, (40, 10, 30, 30))), 1.0).collect() == []
    assert [(r.start_ms, r.label) for r in m.with_bridges(at((0, 900, 1100, (10, 10, 30, 30)), (0, 1900, 2100, (20, 20, 30, 30))), 1.0).collect()] == [(900, "label"), (1000, "label"), (1900, "label")]


def plain_bridges(rows, most):
    """Every finding in order looks through all open ones of its key."""
    out, open_ = [], {}
    for r in sorted((r for r in rows if r[1] in m.SEEN), key=lambda r: (r[4] + (r[5] - r[4]) // 2, r[6], r[7])):
        key, at = (r[0], r[1], r[2], (r[3] or "").strip().lower()), r[4] + (r[5] - r[4]) // 2
        tracks = [t for t in open_.get(key, []) if at - t[0] <= most]
        scored = []
        for i, (then, o) in enumerate(tracks):
            (x, y, w, h), (p, q, v, u) = r[6:10], o[6:10]
            both = max(0, min(x + w, p + v) - max(x, p)) * max(0, min(y + h, q + u) - max(y, q))
            share, far, size = both / (w * h + v * u - both), math.hypot(x + w / 2 - p - v / 2, y + h / 2 - q - u / 2), max(w, h, v, u)
            if then < at and (share >= 0.02 or far <= max(32, 4 * size)):
                scored.append((far / max(1, size) - share, i, far))
        if scored:
            _, i, far = min(scored)
            then, o = tracks.pop(i)
            pad = max(3, math.ceil(far * 0.08))
            left, top = max(0, min(r[6], o[6]) - pad), max(0, min(r[7], o[7]) - pad)
            out.append((r[0], r[1], then, at, left, top, max(r[6] + r[8], o[6] + o[8]) + pad - left, max(r[7] + r[9], o[7] + o[9]) + pad - top, min(r[10], o[10])))
        open_[key] = [*tracks, (at, r)][-128:]
    return out


def test_bridges_as_a_plain_loop_finds_them(spark):
    g = random.Random(6)
    rows = []
    for _ in range(400):
        start = g.randrange(0, 40) * 500 + g.randrange(3)
        rows.append(finding(g.randrange(2), g.choice(["FACE", "OCR_TEXT", "AUDIO"]), g.choice(["", "a", " A "]), start, start + g.choice([400, 600]), (g.randrange(600), g.randrange(400), g.randint(5, 60), g.randint(5, 60)), g.random()))
    rows += [finding(0, "QR_CODE", "hot", i // 150 * 500, i // 150 * 500 + 400, (i % 150 * 40, 0, 9, 9)) for i in range(600)]  # more open tracks than are kept
    got = m.bridges(spark.createDataFrame(rows, m.FINDING).repartition(3), 2.0).collect()
    want = plain_bridges(rows, 1000)
    assert sorted((r.stream, r.kind, r.start_ms, r.end_ms, r.x, r.y, r.w, r.h, r.confidence) for r in got) == sorted(want) and len(want) > 60


def test_filter_graph(spark):
    streams = spark.createDataFrame([("f", 0, "video", 100, 80), ("f", 1, "audio", 0, 0), ("f", 2, "audio", 0, 0), ("f", 3, "subtitle", 0, 0), ("g", 0, "video", 10, 10)], "file string, stream int, type string, width int, height int")
    rows = [finding(0, "FACE", "", 1000, 2500, (-5, 90, 1, 500)), finding(0, "OCR_TEXT", "a", 500, 700, (1, 2, 3, 4)), finding(0, "AUDIO", "b", 0, 100), finding(2, "AUDIO", "c", 0, 1234), finding(3, "SUBTITLE", "d", 0, 10)]
    df = spark.createDataFrame([("f", *r) for r in rows], f"file string, {m.FINDING}")
    got = {r.file: r.script.split(";\n") for r in m.filter_scripts(m.filter_graph(df, streams)).collect()}
    assert got["f"] == [
        "[0:0]drawbox=x=1:y=2:w=3:h=4:color=black:t=fill:enable='between(t,0.500,0.700)'[v0]", "[v0]drawbox=x=0:y=79:w=2:h=80:color=black:t=fill:enable='between(t,1.000,2.500)'[v1]",
        "[0:1]anull[a0]", "[0:2]volume=0:enable='between(t,0.000,1.234)'[a1]",
    ]
    assert got["g"] == ["[0:0]null[v0]"]
    lines = [r.line for r in m.filter_lines(df).collect()]
    assert len(lines) == 4 and sum(x.startswith("volume=0") for x in lines) == 2 and not any("w=0" in x for x in lines)
