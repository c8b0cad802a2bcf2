"""N-grams go through Spark in pieces: arrays by batch and range of hashes."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import backoff_lm
from veilspark.llm.backoff_lm import Backoff, backoff_scores


def test_rows_through_spark_are_far_fewer_than_ngrams(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(400)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, write = {}, backoff_lm.written

    def counted(df, path, **more):
        out = write(df, path, **more)
        seen[path.rpartition("/")[2]] = out.count()
        return out

    monkeypatch.setattr(backoff_lm, "written", counted)
    assert backoff_scores(df).count() == len(texts)
    ngrams = len({g for t in texts for n in (1, 2, 3) for g in zip(*(t.split()[k:] for k in range(n)))})
    assert ngrams > 10_000
    assert 0 < seen["grams"] < ngrams / 100
    assert sum(v for k, v in seen.items() if k.startswith("answers")) == seen["grams"]


@pytest.mark.parametrize("piece", [1, 7, 1 << 12])
def test_totals_of_ranges_over_batches(monkeypatch, piece):
    monkeypatch.setattr(backoff_lm, "PIECE", piece)
    monkeypatch.setattr(backoff_lm, "GRAMS", 50)
    how, ranges = Backoff(slices=2), 6
    batches = [["a b a b c", None, "", "a"], ["b c d " * 20], ["x", "a b"], ["", None]]
    made = [list(backoff_lm.pieces_of(b, texts, how, ranges)) for b, texts in enumerate(batches)]
    assert made[3] == []
    table = pa.Table.from_batches([x for m in made for x in m])
    assert sum(table["words"].to_pylist()) == sum(len((t or "").split()) for texts in batches for t in texts)
    assert len(set(zip(table["b"].to_pylist(), table["at"].to_pylist(), strict=True))) == table.num_rows
    every = collections.Counter()
    for row in table.to_pylist():
        assert 0 < len(row["grams"]) == len(row["n"]) <= piece
        assert all((g % 2**64 >> 32) * ranges >> 32 == row["r"] for g in row["grams"]) and row["s"] == row["r"] // 3
        every.update(dict(zip(row["grams"], row["n"], strict=True)))
    answers = collections.defaultdict(dict)
    for r in set(table["r"].to_pylist()):
        for row in backoff_lm.totals_of(table.filter(np.array(table["r"].to_pylist()) == r)).to_pylist():
            answers[row["b"]][row["at"]] = row["totals"]
    for b, texts in enumerate(batches[:3]):
        _, hashes, inside = backoff_lm.grams_of(*backoff_lm.texts_of(pa.array(texts, pa.large_string())), how.order)
        keys = np.unique(np.concatenate([h[i] for h, i in zip(hashes, inside, strict=True)]))
        assert [x for at in sorted(answers[b]) for x in answers[b][at]] == [every[int(k)] for k in keys.view(np.int64)]


def test_texts_without_words_and_no_texts(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (4, "a b"), (4, "a b"), (5, "b")]
    got = {(r.doc_id, r.n_words, None if r.score is None else round(r.score, 6)) for r in backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), Backoff(slices=2, groups=2)).collect()}
    assert got == {(1, 0, None), (2, 0, None), (None, 0, None), (4, 2, round(float(np.log(1 / 3)), 6)), (5, 1, round(float(np.log(2 / 4)), 6))}
    assert backoff_scores(spark.createDataFrame([], "doc_id long, text string"), Backoff(slices=2, groups=2)).collect() == []
    assert backoff_scores(spark.createDataFrame([(1, None)], "doc_id long, text string"), Backoff(slices=2, groups=2)).count() == 1
