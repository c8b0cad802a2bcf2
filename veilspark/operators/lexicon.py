"""Place names of a lexicon table in texts, accepted by level, context and neighbourhood.

`lexicon` has (level, code, name); levels are province, prefecture, county, township. A name that several rows hold is
ambiguous. The names become one automaton (a trie with failure links), built once in each Python worker, which reads a text
once whatever the number and lengths of names. The distinct names are sent to the tasks, so they are measured first: up to
`most` bytes. A larger lexicon is joined instead, on equality with the texts' pieces of the lengths that the names have; this
costs a row for each place and length.

Defined cases: a null or empty text has no places. Rows of equal key are texts of their own for the automaton; the join
takes them for one. Names of white space are left out; offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels with their priorities; words that make a text speak of places.
LEVELS = {"province": ("CN_ADMIN_PROVINCE", 79), "prefecture": ("CN_ADMIN_PREFECTURE", 78), "county": ("CN_ADMIN_COUNTY", 77), "township": ("CN_ADMIN_TOWNSHIP", 76)}
PLACE_WORDS = (
    "地址", "住址", "住所", "户籍", "籍贯", "所在地", "居住地", "现住", "出生地", "送达", "邮寄", "通信地址", "联系地址",
    "行政区划", "省份", "城市", "区县", "乡镇", "街道", "镇街", "苏木", "不动产", "房屋坐落", "项目地点",
)


def terms(lexicon: DataFrame) -> DataFrame:
    """A row for each name: its highest level, and whether it is ambiguous."""
    rank = F.map_from_arrays(F.array(*map(F.lit, LEVELS)), F.array(*(F.lit(p) for _, p in LEVELS.values())))
    known = lexicon.where(F.trim("name") != "").withColumn("priority", F.element_at(rank, F.col("level")))
    return known.groupBy("name").agg(F.max_by("level", "priority").alias("level"), F.max("priority").alias("priority"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


#: How far a higher level may be, how far a place word, and the bytes of names that are sent to tasks.
REACH, WINDOW, MOST = 16, 24, 32 << 20

_AUTOMATA: dict[int, object] = {}


def _automaton(number: int, names: list[tuple[str, str, bool]]) -> object:
    """The names' automaton, built once in a worker."""
    if number not in _AUTOMATA:
        import ahocorasick

        own = ahocorasick.Automaton()
        for name, level, ambiguous in names:
            own.add_word(name, (name, level, ambiguous))
        own.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[number] = own
    return _AUTOMATA[number]


def accepted(text: str, found: list[tuple[int, int, str, str, bool]], reach: int = REACH, window: int = WINDOW) -> Iterator[tuple[int, int, str, str]]:
    """Which of a text's names (start, end, name, level, ambiguous) count, by start, the longer first."""
    words = re.compile("|".join(map(re.escape, PLACE_WORDS)))
    found.sort(key=lambda x: (x[0], -x[1]))
    high = [(a, b) for a, b, _, level, _ in found if level in ("province", "prefecture")]
    starts = [a for a, _ in high]
    tops: list[tuple[int, int]] = []  # the two furthest ends so far, for a name isn't its own neighbour
    first = second = -1
    for _, b in high:
        first, second = (b, first) if b > first else (first, max(second, b))
        tops.append((first, second))
    for a, b, name, level, ambiguous in found:
        ok = level in ("province", "prefecture") or level == "county" and not ambiguous
        if not ok:
            n = bisect_right(starts, b + reach)
            ok = n > 0 and tops[n - 1][0] >= a - reach  # these levels aren't among the higher ones
        if not ok:
            ok = words.search(f"{text[max(0, a - window) : a]}\0{text[b : b + window]}".lower()) is not None
        if ok:
            yield a, b, name, level


def _scanned(names: list[tuple[str, str, bool]], number: int, key_type: pa.DataType, reach: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(number, names) if names else None
        for batch in batches if names else ():
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                found = [(end + 1 - len(name), end + 1, name, level, ambiguous) for end, (name, level, ambiguous) in automaton.iter(text)]
                rows += [(i, name, level, a, b, n) for n, (a, b, name, level) in enumerate(accepted(text, found, reach, window), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]).cast(key_type), *arrays[1:]], names=["k", "name", "level", "start", "end", "place"])

    return run


def places(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """A row for each accepted place: key, name, level, start, end, and place, its number in the text by start, the longer first.

    Provinces and prefectures always count; a county if it is unambiguous, or near a place word or a higher level; a
    township only near a place word or a higher level."""
    known = terms(lexicon)
    size = known.agg(F.coalesce(F.sum(F.octet_length("name") + 64), F.lit(0))).first()[0]
    if size > most:
        w = Window.partitionBy(key).orderBy("start", F.desc("end"))
        return _joined(df, known, key, text, reach, window).withColumn("place", F.row_number().over(w))
    names = [(r.name, r.level, r.ambiguous) for r in known.select("name", "level", "ambiguous").collect()]  # `most` bytes
    kind = df.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    shape = f"k {kind.simpleString()}, name string, level string, start int, end int, place int"
    number = hash((frozenset(names), len(names)))
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_scanned(names, number, to_arrow_type(kind), reach, window), shape).withColumnRenamed("k", key)


def _joined(df: DataFrame, known: DataFrame, key: str, text: str, reach: int, window: int) -> DataFrame:
    sizes = sorted(r[0] for r in known.select(F.length("name")).distinct().collect())  # lengths, a few dozen at most

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(0), F.length(text) - n)
        cut = F.transform(at, lambda i: F.struct(i.alias("start"), F.substring(F.col(text), i + 1, F.lit(n)).alias("name")))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<struct<start:int,name:string>>"))

    every = F.flatten(F.array(*map(grams, sizes))) if sizes else F.array().cast("array<struct<start:int,name:string>>")
    # keys and pieces only; texts come back for what is found
    cut = df.where(F.col(text) != "").select(key, F.explode_outer(every).alias("g")).select(key, "g.start", "g.name")
    hits = cut.join(known, "name").withColumn("end", F.col("start") + F.length("name"))
    hits = hits.dropDuplicates([key, "start", "name"]).join(df.select(key, text).dropDuplicates([key]), key)
    before = F.substring(F.col(text), F.greatest(F.col("start") - window, F.lit(0)) + 1, F.least(F.col("start"), F.lit(window)))
    context = F.lower(F.concat(before, F.lit("\0"), F.substring(F.col(text), F.col("end") + 1, F.lit(window)))).rlike("|".join(PLACE_WORDS))
    high = F.col("level").isin("province", "prefecture")
    w = Window.partitionBy(key).orderBy("start")
    last = F.max(F.when(high, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.min(F.when(high, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(last >= F.col("start") - reach, F.lit(False)) | F.coalesce(next_ <= F.col("end") + reach, F.lit(False))
    ok = high | (F.col("level") == "county") & (~F.col("ambiguous") | context | near) | (F.col("level") == "township") & (context | near)
    return hits.withColumn("_ok", ok).where("_ok").select(key, "name", "level", "start", "end")
