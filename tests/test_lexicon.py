"""Place names against brute force, by the automaton and by the join, and the time of a large lexicon."""

import random
import time

import pytest

from veilspark.operators import lexicon as x

LETTERS = "东南西北中山河州城县镇乡海江平安"


def rows_of(seed, n):
    r = random.Random(seed)
    levels = list(x.LEVELS)
    return [(r.choice(levels), str(i), "".join(r.choice(LETTERS) for _ in range(r.randint(1, 4)))) for i in range(n)]


def brute(text, lexicon, reach=16, window=24):
    by = {}
    for level, _, name in lexicon:
        by.setdefault(name, []).append(level)
    best = {name: (max(own, key=lambda v: x.LEVELS[v][1]), len(own) > 1) for name, own in by.items()}
    found = [(a, a + len(name), name, *best[name]) for name in best for a in range(len(text)) if text.startswith(name, a)]
    out = []
    for a, b, name, level, ambiguous in sorted(found, key=lambda f: (f[0], -f[1])):
        near = any(q >= a - reach and p <= b + reach and (p, q) != (a, b) and lv in ("province", "prefecture") for p, q, _, lv, _ in found)
        around = text[max(0, a - window) : a] + "\0" + text[b : b + window]
        context = any(w in around for w in x.PLACE_WORDS)
        if level in ("province", "prefecture") or level == "county" and (not ambiguous or context or near) or level == "township" and (context or near):
            out.append((a, b, name, level))
    return out


@pytest.mark.parametrize("most", [x.MOST, 0])
def test_places(spark, most):
    r = random.Random(1)
    lexicon = rows_of(2, 60)
    texts = ["".join(r.choice(LETTERS + "的在了，。x\U0001f600" * 3) for _ in range(r.randint(0, 120))) + r.choice(["", "地址", "所在地：东山"]) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([*lexicon, ("county", "9", "  "), lexicon[0]], "level string, code string, name string")
    got = x.places(df, known, most=most).collect()
    want = [(i, *p, n) for i, t in enumerate(texts) for n, p in enumerate(brute(t or "", [*lexicon, lexicon[0]]), 1)]
    assert sorted((g.doc_id, g.start, g.end, g.name, g.level, g.place) for g in got) == sorted(want) and len(want) > 50


def test_large_lexicon_is_linear(spark):
    """A text of 60,000 characters and more against 40,000 names."""
    r = random.Random(3)
    names = {"".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randint(2, 6))) for _ in range(40_000)}
    known = spark.createDataFrame([("township", str(i), n) for i, n in enumerate(sorted(names))], "level string, code string, name string").cache()
    df = spark.createDataFrame([("a", "完全不包含行政区划名称的合成段落。" * 60_000), ("b", "行政区划：" + sorted(names)[7])], "doc_id string, text string")
    known.count()
    began = time.time()
    assert [(g.doc_id, g.name, g.start) for g in x.places(df, known).collect() if g.doc_id == "b"] == [("b", sorted(names)[7], 5)]
    assert time.time() - began < 10


def test_empty_lexicon(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert x.places(df, spark.createDataFrame([], "level string, code string, name string")).collect() == []
