"""Files taken in by a stream: checked, each once, without what broke off; boxes of spans against a loop."""

import hashlib
import random
import shutil

from veilspark.operators.boxes import glyph_boxes
from veilspark.streaming import ingest as g


def test_ingest(spark, tmp_path):
    src, store, ck = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    (src / "sub").mkdir(parents=True)
    pdf = b"%PDF-1.7 x"
    given = {"a.pdf": pdf, "sub/b.docx": b"PK\x03\x04rest", "c.txt": b"text", "d.pdf": b"no pdf", "e.png": b"", "f.pdf": pdf, "g.pdf": pdf + b"y", "h.zip": b"PK" + bytes(5000)}
    for name, content in given.items():
        (src / name).write_bytes(content)
    declared = spark.createDataFrame([("a.pdf", len(pdf), hashlib.sha256(pdf).hexdigest().upper()), ("f.pdf", len(pdf) + 3, None), ("g.pdf", None, hashlib.sha256(pdf).hexdigest())], "path string, size long, sha256 string")
    run = lambda: g.ingest(spark, str(src), store, ck, declared, limit=4000, files_a_batch=3).awaitTermination(120)
    run()
    rows = {r.path.rsplit("/", 1)[-1]: r for r in g.ingested(spark, store).collect()}
    assert {k: r.refused for k, r in rows.items()} == {"a.pdf": None, "b.docx": None, "c.txt": "no processor", "d.pdf": "not what its name says", "f.pdf": "another length than declared", "g.pdf": "another hash than declared", "h.zip": "above the limit"}
    assert rows["a.pdf"].sha256 == hashlib.sha256(pdf).hexdigest() and rows["h.zip"].sha256 is None and rows["b.docx"].processor == "docx"
    # a batch without its line in the ledger is as if it weren't there; run again, it is there once
    last = max(r.batch for r in rows.values())
    shutil.rmtree(f"{store}/ledger/batch={last}")
    for part in (tmp_path / "ck" / "commits").glob(f"*{last}*"):
        part.unlink()
    assert {r.batch for r in g.ingested(spark, store).collect()} == set(range(last))
    (src / "z.pdf").write_bytes(pdf)
    run()
    names = sorted(r.path.rsplit("/", 1)[-1] for r in g.ingested(spark, store).collect())
    assert names == sorted([*(n.rsplit("/", 1)[-1] for n in given if n != "e.png"), "z.pdf"])


def test_span_boxes(spark):
    r = random.Random(4)
    glyphs = [(k, i, i // 30, i % 30 * 7, i // 30 * 12, r.choice([0, 5, 6]), 11) for k in ("a", "b", None) for i in r.sample(range(400), 300)]
    spans = [(r.choice(["a", "b", "c", None]), s := r.randrange(0, 400), s + r.choice([0, 1, 3, 70, 200])) for _ in range(80)]
    got = glyph_boxes(spark.createDataFrame([*spans, spans[0]], "k string, start int, end int"), spark.createDataFrame(glyphs, "k string, at int, line int, x int, y int, w int, h int"), "k", 16)
    want = []
    for k, a, b in set(spans):
        for line in range(14):
            own = [q for q in glyphs if q[0] == k and k and a <= q[1] < b and q[2] == line and q[5]]
            if own:
                x, y = min(q[3] for q in own), min(q[4] for q in own)
                want.append((k, a, b, line, x, y, max(q[3] + q[5] for q in own) - x, max(q[4] + q[6] for q in own) - y, len(own)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60
