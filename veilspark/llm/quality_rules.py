"""Quality rules whose thresholds follow the data: quantile sketches per language and source, then a joined filter.

Each text is measured once (`measures`). A fixed base rule rejects what is broken everywhere. For the rest,
mergeable KLL sketches of four ratios are built per (lang, source) and per lang: Spark merges partial sketches of
a few kB, so a group that holds a third of all rows costs no task more than the others. The sketches' quartiles
give each group its upper and lower fences, which are joined back to the measured rows.

Defined cases: a null or empty text has no words and fails the base rule; null lang or source is a group of its
own; a group of fewer than `least` rows uses its language's fences; repeated rows are judged alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import SPACES, durable, runs, texts_of, window_hashes, word_hashes, words_of

WINDOW = 8
#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Fences:
    """How far beyond the quartiles of its group a ratio may lie, and the slack that even a constant ratio has."""

    widths: float = 6.0
    slack: tuple[float, float, float, float] = (1.5, 0.05, 0.3, 0.25)
    least: int = 50
    k: int = 200


def measure(data: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, given as UTF-8 bytes."""
    begin, end, _ = words_of(data, np.array([0, len(data)]))
    n = len(begin)
    if n == 0:
        return 0, 0, int(_SYMBOL[data].sum()), 0, 0, 0
    chars = int(_LEAD[data].sum() - np.isin(data, list(SPACES)).sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > WINDOW:
        hashes = window_hashes(word_hashes(data, begin, end), WINDOW)
        _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        again = count[back] > 1
        if again.any():
            cover = np.zeros(n + 1, np.int64)
            hit = np.flatnonzero(again)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = texts_of(batch.column("text"))
        for i, j in runs(starts):
            got = np.array([measure(data[starts[r] : starts[r + 1]]) for r in range(i, j)], np.int64).reshape(-1, 6)
            part = batch.slice(i, j - i)
            kept = [x for x in part.schema.names if x != "text"]
            made = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), *(pa.array(got[:, c]) for c in range(6))], names=[*kept, *made])


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` and the measures of each row's whole text; `text` itself isn't kept."""
    own = docs.select(*keep, F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return own.mapInArrow(_measured, f"{kinds}, {MEASURES}")


def _ratios() -> dict[str, object]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


def thresholds(measured: DataFrame, by: list[str], fences: Fences) -> DataFrame:
    """A row for each group of rows that pass the base rule: its size, and a lower and an upper fence for each ratio."""
    names = list(_ratios())
    good = measured.where(~F.col("base_failed"))
    sketched = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n_group"), *(F.kll_sketch_agg_double(x, F.lit(fences.k)).alias(x) for x in names))
    out = sketched
    for x, slack in zip(names, fences.slack, strict=True):
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col(x), F.lit(q)) for q in (0.25, 0.75))
        reach = fences.widths * (q3 - q1) + F.lit(slack)
        out = out.withColumn(f"{x}_low", q1 - reach).withColumn(f"{x}_high", q3 + reach)
    return out.drop(*names)


def quality_rules(docs: DataFrame, fences: Fences | None = None, most_groups: int = 20_000) -> DataFrame:
    """One row per row of `docs` (doc_id, lang, source, text), with the measures, base_failed and kept.

    The table of thresholds is broadcast only where it has at most `most_groups` rows (a few hundred bytes each),
    which is counted first; a larger one is joined by a sort-merge join whose skewed keys Spark splits.
    """
    fences = fences or Fences()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", failed).withColumns(_ratios())
    rows = durable(rows)
    own = thresholds(rows, ["lang", "source"], fences)
    wide = thresholds(rows, ["lang"], fences)
    limits = [f"{x}_{side}" for x in _ratios() for side in ("low", "high")]
    w = wide.select(F.col("lang").alias("w_lang"), *(F.col(x).alias(f"w_{x}") for x in limits))
    both = own.join(w, own["lang"].eqNullSafe(w["w_lang"]), "left")
    small = F.col("n_group") < fences.least
    both = both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.when(small, F.col(f"w_{x}")).otherwise(F.col(x)).alias(x) for x in limits))
    both = durable(both)
    if both.count() <= most_groups:
        both = F.broadcast(both)
    joined = rows.join(both, rows["lang"].eqNullSafe(both["g_lang"]) & rows["source"].eqNullSafe(both["g_source"]), "left")
    inside = F.lit(True)
    for x in _ratios():
        inside = inside & F.coalesce(F.col(x).between(F.col(f"{x}_low"), F.col(f"{x}_high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("g_lang", "g_source", *limits)
