"""Clustering, line dedup and hard negatives against brute force, with awkward rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from veilspark.llm import centroid_clusters as cc
from veilspark.llm import hard_negatives as hn
from veilspark.llm import line_dedup as ld
from veilspark.llm.perfect_hash import PerfectHash, Table


def vector_rows(n, size, seed, labels=3):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) + (i % labels) * 0.1 for _ in range(size)], r.randrange(labels)) for i in range(n)]
    rows += [(i, list(rows[7][1]), rows[7][2]) for i in range(n, n + n // 3)]  # one vector in a quarter of all rows
    odd = [(900, None, 1), (901, [0.1] * (size - 1), 1), (902, [None] + [0.1] * (size - 1), 1), (903, [math.nan] * size, 1), (904, [math.inf] + [0.0] * (size - 1), 1), (905, [], 1)]
    odd += [(906, [1e30] * size, 1), (None, [0.3] * size, 1), (910, [0.0] * size, None), (911, [0.0] * size, 0), rows[0], (0, list(rows[3][1]), 2), (-10, list(rows[5][1]), 1)]
    return rows + odd


def vector_frame(spark, rows, parts=3):
    out = spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<double>, label int, cluster string, score int")
    return out.repartition(parts)


def ints(v, scale=256):
    return None if v is None or any(x is None or not math.isfinite(x) or abs(x) > 1e6 for x in v) else [math.floor(scale * x) for x in v]


def k_means(rows, s):
    kept = [(i, v) for i, v in ((i, ints(v)) for i, v, _ in rows) if v is not None and len(v) == s.size]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{s.seed}{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i4").tobytes()))[: s.clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(s.rounds, -1, -1):
        at = [min((distance(v, x), k) for k, x in enumerate(c)) for _, v in kept]
        if left:
            for k in range(len(c)):
                own = [v for (_, v), (_, j) in zip(kept, at, strict=True) if j == k]
                if own:
                    c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    by = collections.Counter()
    for d, k in at:
        by[k] += d
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, k, d, by[k], sum(by.values()), digests[k]) for (i, _), (d, k) in zip(kept, at, strict=True)]


@pytest.mark.parametrize(("n", "clusters", "levels"), [(60, 7, 127), (60, 200, 3), (3, 2, 127)])
def test_clusters(spark, n, clusters, levels):
    s = cc.Settings(size=10, clusters=clusters, rounds=3, segment=4, levels=levels)
    rows = vector_rows(n, 10, 1) if n > 10 else [(i, [float(i)] * 10, 0) for i in range(n)]
    got = cc.clusters(vector_frame(spark, rows), s).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, k_means(rows, s)))


def test_clusters_of_nothing(spark):
    assert cc.clusters(vector_frame(spark, [(1, None, 1)])).collect() == []
    assert cc.clusters(vector_frame(spark, []), cc.Settings(size=2)).columns[:3] == ["vec_id", "cluster", "distance"]


def test_screening_is_exact_and_prunes():
    r = np.random.default_rng(3)
    s = cc.Settings(size=64)
    centres = r.integers(-200, 200, (40, 64))
    x = centres[r.integers(0, 40, 3000)] + r.integers(-20, 20, (3000, 64))
    x[:50] = centres[:40].repeat(2, axis=0)[:50]
    centres[5] = centres[4]  # a tie goes to the smaller number
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    low = cc.Compressed.of(x, s).bounds(centres, cc.segment_norms(centres, s.segment))
    assert (low <= full).all()
    cluster, best, done = cc.nearest(x, low, centres)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and done < 0.1 * full.size
    far = np.array([[2**27, -(2**27)], [0, 1], [-(2**27), 2**27]])
    assert cc.nearest(far, cc.Compressed.of(far, s).bounds(far, cc.segment_norms(far, 8)), far)[1].tolist() == [0, 0, 0]


def negatives(rows, s):
    v = [(i, ints(v), k) for i, v, k in rows if i is not None and k is not None and ints(v) is not None]
    out = []
    for anchor, a, label in {(i, tuple(x), k) for i, x, k in v if i % s.every == 0}:
        scored = [(-sum(p * q for p, q in zip(a, x, strict=True)), i, k) for i, x, k in v if len(x) == len(a)]
        scored.remove((-sum(p * p for p in a), anchor, label))
        scored.sort(key=lambda r: r[:2])
        for p, positive, _ in [r for r in scored if r[2] == label][: s.positives]:
            fit = [r for r in scored if r[2] != label and s.low * -p <= 100 * -r[0] <= s.high * -p][: s.negatives]
            out += [(anchor, positive, n + 1, r[1], -p, -r[0]) for n, r in enumerate(fit)]
    return out


@pytest.mark.parametrize("slab", [4, 1000])
def test_hard_negatives(spark, slab):
    s = hn.Settings(every=5, positives=3, negatives=4, slab=slab, block=16, scores=200)
    rows = vector_rows(60, 8, 2)
    rows += [(1000, rows[7][1], rows[7][2]), (1000, rows[7][1], rows[7][2]), (1005, [0.5], 1), (1006, [0.25], 1), (1007, [0.2], 0), (1010, [], 0)]
    got = hn.hard_negatives(vector_frame(spark, rows, 4), s).collect()
    want = negatives(rows, s)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    assert hn.hard_negatives(vector_frame(spark, [])).collect() == []
    assert hn.hard_negatives(vector_frame(spark, [(100, [0.5], 1), (1, [0.5], 2)])).collect() == []


def test_large_products_are_exact():
    a = np.array([[2**29, 2**29 - 1], [3, -(2**29)]])
    assert hn.products(a, a).tolist() == [[int(x) * int(p) + int(y) * int(q) for p, q in a] for x, y in a]


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 5000):
        one, two = (r.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        hashed, place = PerfectHash.of(one)
        assert sorted(place) == list(range(n)) == sorted(hashed.places(one)) and len(hashed) == n
        assert len(hashed.words) * 64 <= 64 * 30 + 5 * n
        if n:
            t = Table.read(Table.of(one, two, np.arange(n), np.arange(n) * 7).bytes())
            at = t.find(one, two)
            assert (t.holder[at] == np.arange(n) * 7).all() and (t.count[at] == np.arange(n)).all()
            assert (t.find(one, two + np.uint64(1)) == -1).all() and (t.find(*(r.integers(0, 2**64, 999, dtype=np.uint64) for _ in range(2))) == -1).all()
    one, two = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)  # the first halves fall together
    t = Table.read(Table.of(one, two, np.ones(3, int), np.array([10, 20, 30])).bytes())
    assert t.holder[t.find(one, two)].tolist() == [10, 20, 30] and t.find(np.array([5], np.uint64), np.array([7], np.uint64)).tolist() == [-1]


def lines(rows, least=10):
    """Rows without an id are documents of their own; any one of equal ones may be the first."""
    named = [(i, t or "") for i, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    holder = {}
    order = {id(r): (r[0] is None, r[0] if r[0] is not None else n) for n, r in enumerate(named)}
    for r in sorted(named, key=lambda r: order[id(r)]):
        for x in r[1].split("\n"):
            if len(key(x)) >= least:
                holder.setdefault(key(x), order[id(r)])
    out = []
    for r in named:
        all_lines = r[1].split("\n")
        kept = [x for x in all_lines if len(key(x)) < least or holder[key(x)] == order[id(r)]]
        out.append((r[0], len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    r = random.Random(4)
    pool = ["  Shared Line Number One\t", "shared line number one", "SHARED LINE NUMBER ONE\r", "short", "", "   ", "ééééééééé", "éééééééééé", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää", "\x0bvertical tab line\x0c", "vertical tab line", "tail at the end ", " no-break rim kept ", "no-break rim kept"]
    pool += [f"a line of its own {r.random()}" for _ in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in r.sample(range(-20, 1000), 80)]
    rows += [(2000, None), (2001, ""), (2002, "\n"), (2003, "the same\nline again here\nline again here"), (2004, "line again here"), (2005, ("x" * 50_000 + "\n") * 60)]
    rows += [(3000 + i, "a very common line\nand another common line") for i in range(60)] + [(2003, "the same\nline again here"), (2006, "ABCDEFGHI"), (2007, "abcdefghi\nabcdefghij")]
    return rows


@pytest.mark.parametrize("s", [ld.Settings(), ld.Settings(shard=4, most=6), ld.Settings(shard=2, most=2)])
def test_lines(spark, s):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, d int").repartition(3)
    got = sorted((tuple(x) for x in ld.deduplicated(df, s).collect()), key=str)
    assert got == sorted(lines(rows), key=str)
    assert ld.shared_keys(ld.numbered(df), s).count() > 6


def test_lines_without_ids(spark):
    rows = [(None, "held by nobody with an id"), (None, "held by nobody with an id"), (None, "only here, this one"), (5, "held by five and none"), (None, "held by five and none\nand something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = collections.Counter(tuple(x) for x in ld.deduplicated(df).collect())
    assert got == collections.Counter(lines(rows))
    assert sum(n for (_, _, _, kept), n in got.items() if kept == "held by nobody with an id") == 1


def test_no_lines(spark):
    assert ld.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
