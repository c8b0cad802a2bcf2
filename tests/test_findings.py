"""What reviews found on odd inputs and larger tables."""

import io
import zipfile

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from veilspark.operators import detect as d
from veilspark.operators.boxes import glyph_boxes
from veilspark.plans.rules import RuleSet
from veilspark.sources import office


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_made_glyphs_are_not_broadcast(spark):
    # a page's glyphs come from one number, so the optimizer takes many for few
    glyphs = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("at")).select(F.col("id").alias("k"), "at", F.lit(0).alias("line"), (F.col("at") * 6).alias("x"), F.lit(0).alias("y"), F.lit(5).alias("w"), F.lit(9).alias("h"))
    spans = spark.range(80).select((F.col("id") % 40).alias("k"), (F.col("id") % 50).cast("int").alias("start"), (F.col("id") % 50 + 20).cast("int").alias("end"))
    got = glyph_boxes(spans, glyphs, "k")
    assert "BroadcastExchange" not in _plan(got)
    assert {(r.start, r.end, r.x, r.w, r.glyphs) for r in got.where("k = 3").collect()} == {(3, 23, 18, 119, 20), (43, 63, 258, 119, 20)}


def test_what_a_mask_frees_is_masked_too(spark):
    rules = RuleSet().only("BANK_CARD_NUMBER", "EMAIL_ADDRESS", "IPV4_ADDRESS")
    rows = spark.createDataFrame([(1, "a 4665471787434696 86.227.24.100 b"), (2, "71.129.171.132 4815819516090933 c"), (3, "plain"), (4, None), (5, "x@a.org 4111111111111111")], "doc_id long, text string")
    once, all_of_it = d.redact(rules=rules, df=rows), d.redact(rows, rules, passes=d.MOST_PASSES)
    assert {x.value for x in d.residual(once.select("doc_id", "redacted"), rules).collect()} == {"4665471787434696", "4815819516090933"}
    got = {x.doc_id: x for x in all_of_it.collect()}
    assert all_of_it.columns == once.columns
    assert got[1].redacted == "a ＊＊＊＊＊＊＊＊＊＊＊＊＊＊＊＊ ＊＊.＊＊＊.＊＊.＊＊＊ b"
    assert [x.value for x in got[1].found] == ["86.227.24.100"]
    assert (got[3].redacted, got[4].redacted, got[5].redacted) == ("plain", "", "＊@＊.＊＊＊ ＊＊＊＊＊＊＊＊＊＊＊＊＊＊＊＊")
    assert d.residual(all_of_it.select("doc_id", "redacted"), rules).count() == 0


#: A card number beside an address: together they are another number, which is a card number in the third and fourth text.
BESIDE = ["a 4665471787434696 86.227.24.100 b", "71.129.171.132 4815819516090933 c", "a 4495589438270767 42.73.240.87 b", "x.y@mail0.example.com z 38.211.12.42 4366089147969128", "plain"]


def _same_as_sql(spark, tmp_path, name):
    import __spark_entry__ as entry

    spark.createDataFrame([(i, t, f"src{i % 2}") for i, t in enumerate(BESIDE)], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(tmp_path))
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect())) == sorted(expected)


def test_residual_after_masking_beside_sql(spark, tmp_path):
    assert _same_as_sql(spark, tmp_path, "residual_after_masking")


def test_hits_by_source_beside_sql(spark, tmp_path):
    assert _same_as_sql(spark, tmp_path, "hits_by_source")


def test_small_packages_share_frames():
    calls = []

    def package(text):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml", f'<w:document xmlns:w="x"><w:p><w:t>{text}</w:t></w:p></w:document>')
        return box.getvalue()

    files = pd.DataFrame({"path": [f"f{i}" for i in range(300)], "content": [package(f"t{i}") if i % 50 else b"no package" for i in range(300)]})
    for frame in office._read(iter([files[:100], files[100:]])):
        calls.append(frame)
    rows = pd.concat(calls)
    assert len(calls) == 1
    assert rows["file"].tolist() == files["path"].tolist()
    assert rows["error"].notna().tolist() == [i % 50 == 0 for i in range(300)]


def test_units_to_refuse_are_found_with_the_others(spark):
    def package(text, formula):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{text}</t></si></sst>")
            z.writestr("xl/worksheets/s.xml", f'<worksheet><c r="A1" t="str"><f>{formula}</f></c></worksheet>')
        return box.getvalue()

    files = spark.createDataFrame([("a", package("13812345678", "1+1")), ("b", package("13812345678", "X&13812345678".replace("&", "&amp;"))), ("c", package("plain", "A&13812345678".replace("&", "&amp;"))), ("d", package("plain", "1+1"))], "path string, content binary")
    got = {r.path: r for r in office.redacted_packages(files, RuleSet().only("CN_MOBILE_PHONE")).collect()}
    assert {k: (r.changed, r.error is None) for k, r in got.items()} == {"a": (1, True), "b": (1, False), "c": (0, False), "d": (0, True)}
    read = {r.file: r.text for r in office.units(spark.createDataFrame([("a", bytes(got["a"].content))], "path string, content binary")).where("part = 'xl/sharedStrings.xml'").collect()}
    assert read == {"a": "＊" * 11}
