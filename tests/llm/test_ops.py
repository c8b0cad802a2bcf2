"""Each operator against brute force or an exact property on small fixtures, with the awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "ri", "so") for b in ("ran", "del", "pik", "most", "ver", "ga", "shi")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(99, 80)
    base = prose(5, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    out = [prose(1, 200), prose(2, 30) + " " + shared + " " + prose(3, 40), shared + "\n" + prose(4, 50), " ".join(base), " ".join(near), " ".join(base), "", None, "one two", prose(7, 3000), "x y z " * 100, "é" * 300 + " " + shared]
    rows = list(enumerate(out))
    return rows + [(3, out[3]), (None, prose(1, 200)), (20, "word " * 25)]


def frame(spark, rows):
    # other columns with clashing names are ignored or kept as they are
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k string, n long")


def test_packing_round_trip(spark, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from veilspark.llm.packing import Packing, cuts, pack

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = pack(frame(spark, rows).coalesce(1), P.path("word_bpe_49k.json"), Packing(window=256, stretch=4), with_ids=True).collect()
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)) for i, x in rows)
    docs, now = collections.Counter(), []
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        assert r.start == len(now)
        now += r.ids
        if len(now) == r.doc_tokens:
            docs[(r.doc_id, tuple(now))] += 1
            now = []
    assert docs == want
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        sizes.append(at)
    assert sum(256 - n for n in sizes if n & (n - 1)) < 0.05 * sum(sizes)
    # the cheapest chain, against all chains
    place, penalty = np.array([0, 3, 7, 9, 12, 16]), np.array([0, 1.0, 0, 2, 0, 0])

    def cost(c):
        return sum(8 - (place[b] - place[a]) + penalty[b] for a, b in zip(c[:-2], c[1:-1]))

    chains = [[0]]
    for j in range(1, 6):
        chains += [c + [j] for c in chains if place[j] - place[c[-1]] <= 8]
    assert cost(cuts(place, penalty, 8)) == min(cost(c) for c in chains if c[-1] == 5)


def test_packing_every_letter():
    P = pytest.importorskip("public_tokenizers")
    from veilspark.llm.packing import Encoder

    e = Encoder(P.path("word_bpe_49k.json"))
    wrong = []
    for c in map(chr, [*range(1, 0x250), 0x301, 0x1E9E, 0x2019, 0x2126, 0x3042, 0xFB01]):
        for text in (c, f"a{c}b", f"the {c}word", f"one{c} 2{c}3", f"{c}{c.lower()}.{c}'s", f"x {c}\u0301y", f"A{c}B!{c}?"):
            if e.encode(text)[0].tolist() != e.tokenizer.encode(text, add_special_tokens=False).ids:
                wrong.append(text)
    assert not wrong


def test_packing_sentence_ends():
    P = pytest.importorskip("public_tokenizers")
    from veilspark.llm.packing import Encoder

    e = Encoder(P.path("word_bpe_49k.json"))
    for parts in (["It’s a long day.", "We go home!", "Then “who” comes?"], ["今天天气很好。", "我们去公园！", "你来吗？"], ["He said “go.”", "Это дом.", "Конец."]):
        ids, ends = e.encode(" ".join(parts))
        assert ends.tolist() == np.cumsum([len(e.encode(x)[0]) for x in parts]).tolist() and ends[-1] == len(ids)
    assert e.encode("it costs 3.5 — no more")[1].tolist() == [] and e.encode("—")[1].tolist() == []


def test_repeats_brute_force(spark, rows):
    from veilspark.llm.maximal_repeats import Repeats, without_repeats

    for how in (Repeats(), Repeats(most=2), Repeats(length=40, piece=12, most=3, blocks=(9, 3, 1))):
        count, L = collections.Counter(), how.length
        for _, t in rows:
            b = (t or "").encode()
            count.update(b[s : s + L] for s in range(len(b) - L + 1))
        want = []
        for i, t in rows:
            b = (t or "").encode()
            m = np.zeros(len(b) + 1, int)
            for s in range(len(b) - L + 1):
                if count[b[s : s + L]] > 1:
                    m[s : s + L] = 1
            kept = bytes(x for x, y in zip(b, m) if not y)
            want.append((i is None, i or 0, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(frame(spark, rows), how).collect()]
        assert sorted(got) == sorted(want)
    assert without_repeats(frame(spark, [])).count() == 0


def test_similarity_brute_force(spark, rows):
    from veilspark.llm.ngram_join import Join, similar

    rows = rows + [(100 + k, " ".join(prose(50, 150).split()[: 150 - k])) for k in range(12)]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    link = [[bool(sets[a]) and a != b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if link[a][b]:
                    root[a] = root[b] = min(root[a], root[b])
    low = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted((str(rows[i][0]), str(low[root[i]] if sets[i] else rows[i][0]), sum(link[i])) for i in range(n))
    for how in (Join(), Join(block=3)):
        got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in similar(frame(spark, rows), how).collect())
        assert got == want
    assert similar(frame(spark, [])).count() == 0


def test_chunk_dedup_brute_force(spark, rows):
    from veilspark.llm.chunk_dedup import Chunking, chunks, deduplicated

    how = Chunking(bits=4, shortest=8, longest=64, least=30)
    rows = [(i, t) for i, t in rows if i is not None]
    cut = []
    for i, t in rows:
        b = (t or "").encode()
        ends = chunks(np.frombuffer(b, np.uint8), how)
        cut.append((i, b, list(zip([0, *ends[:-1]], ends))))
    holder = {}
    for i, b, spans in sorted(cut, key=lambda x: x[0]):
        for x, y in spans:
            holder.setdefault(b[x:y], i)
    want = []
    for (i, b, spans), (_, t) in zip(cut, rows):
        seen, bad = set(), []
        for x, y in spans:
            bad.append(holder[b[x:y]] != i or b[x:y] in seen)
            seen.add(b[x:y])
        kept, k = b"", 0
        while k < len(spans):
            m = k
            while m < len(spans) and bad[m]:
                m += 1
            if m == k:
                kept, k = kept + b[slice(*spans[k])], k + 1
                continue
            x, y = spans[k][0], spans[m - 1][1]
            if y - x < how.least:
                kept += b[x:y]
            else:
                p, q = x, y
                while p < q and b[p] & 0xC0 == 0x80:
                    p += 1
                while q < len(b) and p < q and b[q] & 0xC0 == 0x80:
                    q -= 1
                kept += b[x:p] + b[q:y]
            k = m
        want.append((i, sum(bad), None if t is None else kept.decode()))
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, repeats int, _d int, _k int, _d0 int, k0 int")
    got = deduplicated(df, how)
    assert sorted(((r.doc_id, r.n_repeats, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {(r.repeats, r._d, r._k, r._d0, r.k0) for r in got.select("repeats", "`_d`", "`_k`", "`_d0`", "k0").collect()} == {(1, 2, 3, 4, 5)}


def test_near_duplicates_by_row(spark):
    from veilspark.llm.ngram_join import deduplicated

    a, b, c = prose(61, 90), prose(62, 90), prose(63, 90)
    docs = [(1, a), (None, a), (None, a), (2, b), (2, a + " tail"), (None, c), (None, b), (7, ""), (8, None), (None, None), (9, c), (9, c)]
    got = deduplicated(spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, d int, k int")).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(1, a), (2, b), (9, c), (7, ""), (8, None), (None, None)], key=str)


def test_labelled_sample(spark):
    from pyspark.sql import functions as F

    from veilspark.llm import compression_classifier as c

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "x"), (None, "n"), (4, "y"), (5, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, None), (None, 1), (5, 1)], "doc_id long, quality int")
    assert sorted(c.sample(docs, labels, "quality", F.col("doc_id") != 5, 10, 1)) == [("a", 1), ("x", 0)]
    for rows, known in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        got = c.score(rows, c.fit(rows, known, F.lit(True)))
        assert got.count() == rows.count() and all(r.score == pytest.approx(r.score) and 0 <= r.score <= 1 for r in got.collect())


def test_chunk_dedup(spark, rows):
    from veilspark.llm.chunk_dedup import Chunking, chunks, deduplicated

    got = deduplicated(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    shared = prose(99, 80)
    assert by[0].n_removed == 0 and by[1].n_removed == 0 and by[9].n_removed == 0
    assert by[2].n_removed > 0.5 * len(shared) and by[11].n_removed > 0.5 * len(shared)
    assert by[5].text == "" and by[7].text is None and by[6].text == "" and by[0].k == "k"
    for r in got:
        assert r.text is None or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    # an insertion moves the chunk ends near it only
    a = prose(11, 2000).encode()
    b = a[:5000] + b"INSERTED" + a[5000:]

    def cut(x):
        ends = chunks(np.frombuffer(x, np.uint8), Chunking())
        return {x[i:j] for i, j in zip([0, *ends[:-1]], ends)}

    assert len(cut(a) ^ cut(b)) <= 6
    assert deduplicated(frame(spark, [])).count() == 0


def test_decontamination(spark):
    from veilspark.llm.decontaminate import decontaminated, leaks

    item = "A train leaves Paris at 40 km per hour and travels 120 km before it meets another train coming from the north side"
    other = item.replace("40", "70").replace("120", "210")
    broken = "so 40 apples and 40 pears and 40 plums make up one very full basket for the market today"
    docs = [(1, "Noise first. " + item + " noise after."), (2, "Before it. " + other), (3, prose(1, 100)), (4, None), (5, ""), (6, broken.replace("40 pears", "41 pears")), (7, broken.replace("40", "77")), (1, "Noise first. " + item + " noise after."), (None, "See. " + item)]
    bench = spark.createDataFrame([(10, item), (11, broken), (12, None), (13, "short one")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in leaks(frame(spark, docs), bench).collect())
    assert got == [("1", 10), ("2", 10), ("7", 11), ("None", 10)]
    kept = decontaminated(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_small_and_plain_items(spark):
    from veilspark.llm.decontaminate import leaks

    items = [(1, "What is 12 + 15?"), (2, "Find the value of 12 kg 5 lb 7 oz in grams"), (3, "Solve 3 4 5 6 7 8 9 10 for x"), (4, "Anna buys 5 apples and 7 pears there"), (5, "Der Hund und die Katze im Haus am See bei Berlin"), (6, "The red bus. The old train. The big ship. The new car waits for them")]
    pad = "some words before and then. {} and words after it"
    docs = [(i, pad.format(t)) for i, t in items]
    docs += [(24, pad.format("Peter buys 9 apples and 3 pears there")), (26, "It is so. The red bus. A old train. The big ship. The new car waits for them"), (33, pad.format("Solve 3 4 5 6 7 8 9 11 for y")), (40, "What is this + that? Find the value. " + prose(3, 60)), (41, items[0][1])]
    got = sorted((r.doc_id, r.item_id) for r in leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(i, i) for i in range(1, 7)] + [(24, 4), (26, 6), (41, 1)]


def test_decontamination_by_a_large_benchmark(spark):
    from veilspark.llm.decontaminate import Matching, leaks, matches

    items = [(i, prose(300 + i, 30)) for i in range(6)] + [(None, prose(300, 30)), (9, None)] + [(10 + i, prose(301, 30)) for i in range(40)]
    docs = [(i, f"Noise {i} first. " + items[i % 6][1] + " noise after. " + prose(900 + i, 200)) for i in range(24)] + [(None, items[0][1])] * 3 + [(50, ""), (51, None)]
    docs, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.drop("k").collect()))
    got = rows(leaks(docs, bench))
    assert len(got) == 24 + 4 * 40 + 4 + 2
    for most_bytes in (20_000, 0):
        assert rows(leaks(docs, bench, Matching(most_bytes=most_bytes))) == got

    def joined(plan):
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            yield plan.joinType().toString(), plan.condition().toString(), [{k.output().apply(i).name() for i in range(k.output().size())} for k in kids]
        for k in kids:
            yield from joined(k)

    def windows_joined(df):
        return [(how, sides[0]) for how, on, sides in joined(df._jdf.queryExecution().optimizedPlan()) if "(w#" in on]

    # what is shuffled for the windows' join holds a window's words at most, not the text's
    (how, left), (semi, _) = windows_joined(matches(docs, bench, Matching(most_bytes=20_000)))
    assert (how, semi) == ("Inner", "LeftSemi") and "own" in left and "v" not in left
    ((how, left),) = windows_joined(matches(docs, bench, Matching(most_bytes=0)))
    assert how == "Inner" and not left & {"own", "v"}
    # items with the same texts are looked for once, so their windows are few enough here
    assert len(windows_joined(leaks(docs, bench, Matching(most_bytes=60_000)))) == 1 and len(windows_joined(matches(docs, bench, Matching(most_bytes=60_000)))) == 2


def test_quality_rules_measures(spark, rows):
    from veilspark.llm.quality_rules import quality_rules

    rows = rows + [(30, "a # b\n\n a # b\na # b\n" + "w " * 30)]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
    want = []
    for i, t in rows:
        t = t or ""
        w = t.split()
        win = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.split()]
        want.append((str(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert got == sorted(want)
    assert quality_rules(docs.limit(0)).count() == 0


def labelled(n, marked):
    return [(prose(1000 + i, 60) if i % 2 else marked(prose(1000 + i, 60)), i % 2) for i in range(n)]


def test_compression_classifier():
    from veilspark.llm import compression_classifier as c

    bad = lambda t: " ".join(w + "$$$" for w in t.split())
    m = c.fit_texts(labelled(120, bad), c.Settings())
    test = [(prose(9000 + i, 80), 1) for i in range(30)] + [(bad(prose(9500 + i, 80)), 0) for i in range(30)]
    s = c.score_bytes(m, [t.encode() for t, _ in test])
    assert (((s >= 0.3) == [y for _, y in test]).mean()) > 0.95
    assert c.score_bytes(m, [b""])[0] == m.prior
    assert c.score_bytes(c.fit_texts([], c.Settings()), [b"abc"])[0] == pytest.approx(0.5)


def test_toxicity_network():
    from veilspark.llm import toxicity as t
    from veilspark.llm.common import texts_of

    import pyarrow as pa

    mark = lambda x: " ".join([*x.split()[:30], "vilestuff", *x.split()[30:]])
    data = [(x, 1 - y) for x, y in labelled(240, mark)]
    m = t.fit_texts(data, t.Settings(rounds=120))
    test = [(prose(9000 + i, 90), 0) for i in range(30)] + [(mark(prose(9500 + i, 90)), 1) for i in range(30)]
    s = t.Scorer(m).score(*texts_of(pa.array([x for x, _ in test])))
    assert ((s >= 0.5) == [bool(y) for _, y in test]).mean() > 0.9
    assert 0 <= t.Scorer(m).score(*texts_of(pa.array(["", None])))[0] < 0.5
    # gradients against differences
    r, w = np.random.default_rng(0), {k: v.astype(np.float64) for k, v in t._start(t.Settings(hidden=3)).items()}
    x, y = r.normal(size=(5, 4, t.INPUTS)), np.array([0, 1, 1, 0.0])
    mask = np.arange(5)[:, None] < np.array([5, 3, 4, 1])
    loss = lambda: -(y * np.log(p := t.forward(x, mask, w)) + (1 - y) * np.log(1 - p)).mean()
    g = t._gradient(x, mask, y, w)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-4
        high = loss()
        w[k][at] -= 2e-4
        low = loss()
        w[k][at] += 1e-4
        assert g[k][at] == pytest.approx((high - low) / 2e-4, abs=1e-4)


def test_backoff_brute_force(spark, rows):
    from veilspark.llm.backoff_lm import Backoff, backoff_scores

    how = Backoff(order=3, batch_bytes=2000, slices=2, groups=2)
    texts = [(t or "").split() for _, t in rows]
    grams = lambda w: collections.Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(grams, texts), collections.Counter())
    N = sum(map(len, texts))
    want = []
    for (i, _), w in zip(rows, texts):
        own, s = grams(w), 0.0
        c = lambda g: total[g] - own[g]
        for k in range(len(w)):
            v = np.log(max(c((w[k],)), 1) / max(N - len(w), 1))
            for n in (2, 3):
                if k >= n - 1:
                    g = tuple(w[k - n + 1 : k + 1])
                    v = np.log(c(g) / c(g[:-1])) if c(g) > 0 and c(g[:-1]) > 0 else np.log(how.alpha) + v
            s += v
        want.append((str(i), len(w), round(s, 6)))
    got = [(str(r.doc_id), r.n_words, round(r.score or 0.0, 6) if r.n_words else 0.0) for r in backoff_scores(frame(spark, rows), how).collect()]
    assert sorted(got) == sorted(want)


def test_backoff_registered_order(spark, rows, tmp_path):
    from veilspark.llm.backoff_lm import Backoff, backoff_scores
    from veilspark.llm.queries import op3_backoff_lm

    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    shown = lambda df: sorted((str(r.doc_id), r.n_words, str(round(r.score, 6)) if r.n_words else "") for r in df.collect())
    got = shown(op3_backoff_lm(spark, str(tmp_path)))
    assert got == shown(backoff_scores(frame(spark, rows), Backoff(order=3)))
    assert got != shown(backoff_scores(frame(spark, rows), Backoff(order=2)))


def test_quotes(spark):
    from veilspark.llm.quotes import linked

    m = [(1, 0, "Hello there my friend\nsecond line of words"), (1, 1, "> Hello there my friend\n> second line of words\nI agree with this one"), (1, 2, "> > hello there, my friend\n> I agree with this one\nThird message here now"), (1, 3, "> hello there my friend\nanother reply"), (1, 4, None), (None, 0, "> q q q"), (2, 0, "> unknown quote words\nbody"), (2, 0, "> unknown quote words\nbody")]
    df = spark.createDataFrame([(a, b, "r", t) for a, b, t in m], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in linked(df).collect()}
    assert [(got[1, t].reply_to, got[1, t].thread, got[1, t].depth) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (0, 0, 1), (None, 4, 0)]
    assert got[1, 1].own == "I agree with this one" and got[2, 0].own == "body" and got[1, 4].own == ""
    assert linked(df).count() == len(m) and linked(df.limit(0)).count() == 0


def test_quotes_of_any_length(spark):
    from veilspark.llm.quotes import linked

    m = [(0, "Yes, agreed"), (1, "> Yes, agreed\nfine"), (2, "今天天气很好。\n我们去公园。"), (3, "> 我们去公园。\n好的"), (4, ":)"), (5, "> :)\nwhat is it"), (6, "ok"), (7, "> OK\nthen")]
    got = {r.turn: r for r in linked(spark.createDataFrame([(1, a, "r", t) for a, t in m], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(8)] == [None, 0, None, 2, None, 4, None, 6]


def test_quotes_reply_order(spark):
    from veilspark.llm.quotes import conversations, with_passages

    m = [(0, "alpha start"), (1, "beta start"), (2, "> alpha start\nreply one"), (3, "> beta start\nreply two"), (4, "> > alpha start\n> reply one\ndeep"), (5, "> alpha start\nreply three")]
    df = spark.createDataFrame([(1, a, "r", t) for a, t in m], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.own) for r in conversations(df).collect()] == [(0, "alpha start"), (2, "reply one"), (4, "deep"), (5, "reply three"), (1, "beta start"), (3, "reply two")]
    rows = spark.createDataFrame([([(0, "a"), (0, "b"), (0, " "), (1, "c"), (1, ""), (1, "d"), (0, "e")],), ([(0, "")],)], "lines array<struct<level:int,body:string>>")
    assert [[(p.level, p.body) for p in r.passages] for r in with_passages(rows).collect()] == [[(0, "a\nb"), (1, "c"), (1, "d"), (0, "e")], []]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as c

    bad = lambda t: " ".join(w + "$$$" for w in t.split())
    item = "what is the long tall answer to this question about green boats and red houses in summer"
    docs = [(i, bad(prose(i, 80)) if i % 4 == 0 else prose(i, 80)) for i in range(80)]
    docs += [(200, prose(1, 80)), (201, prose(301, 50) + " " + item), (202, prose(2, 80) + " tail")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in docs if i < 80], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {r.doc_id for r in c.run(spark, str(tmp_path)).collect()}
    assert ids == {i for i in range(80) if i % 4}
