import zipfile

from pyspark.sql import functions as F

from veilspark.operators import boxes, files, lexicon
from veilspark.plans.rules import RuleSet
from veilspark.sources.office import text_units


def test_lexicon(spark):
    rows = [("province", "1", "江南省"), ("county", "2", "东区"), ("county", "3", "东区"), ("county", "4", "安平县"), ("township", "5", "石桥镇")]
    known = spark.createDataFrame(rows, "level string, code string, name string")
    texts = [(0, "江南省东区的事"), (1, "东区很大"), (2, "安平县和石桥镇"), (3, "住址是石桥镇"), (4, None), (5, "")]
    got = {(r.doc_id, r.name, r.start) for r in lexicon.places(spark.createDataFrame(texts, "doc_id long, text string"), known).collect()}
    assert got == {(0, "江南省", 0), (0, "东区", 3), (2, "安平县", 0), (3, "石桥镇", 3)}


def test_boxes(spark):
    df = spark.createDataFrame([([(0, 0, 10, 10, 0.9), (1, 1, 10, 10, 0.95), (50, 50, 5, 5, 0.85), (0, 0, 1, 1, 0.1)],)], f"b array<{boxes.BOX}>")
    assert [(x.x, x.score) for x in df.select(boxes.suppressed(F.col("b"))).first()[0]] == [(1, 0.95), (50, 0.85)]
    words = [(1, 1, "call", 0, 0, 40, 10, 90.0), (1, 2, "138", 45, 2, 30, 10, 80.0), (1, 3, "12345678", 80, 0, 75, 12, -1.0)]
    w = spark.createDataFrame(words, "line long, row int, text string, `left` int, top int, width int, height int, conf double")
    phone = RuleSet().only().with_lists(black=["138 12345678"])
    got = boxes.word_boxes(w, phone, "line").first()
    assert (got["left"], got["top"], got["width"], got["height"], got["confidence"]) == (45, 0, 110, 12, 0.8)


def test_files(spark):
    names = spark.createDataFrame([("a/b/CON.txt",), ("x<y>.pdf",), ("..",), ("C:\\dir\\f.doc ",)], "n string")
    assert [r[0] for r in names.select(files.safe_name(F.col("n"))).collect()] == ["_CON.txt", "x_y_.pdf", "upload", "f.doc"]
    df = spark.createDataFrame([("scan 13812345678.tar.gz",), ("😀" * 220 + ".pdf",)], "n string")
    got = [r.new_name for r in files.redacted_names(df, "n", RuleSet().only("CN_MOBILE_PHONE")).collect()]
    assert got[0] == "scan REDACTED_脱敏.tar.gz" and len(got[1]) == 180 and got[1].endswith("_脱敏.pdf")
    c = files.capacity(spark.createDataFrame([("a.docx", 512 << 20), ("b.png", 64 << 20)], "n string, s long"), "n", "s").first()
    assert (c.files, c.bytes, c.peak) == (2, 576 << 20, (576 << 20) + c.workspace)
    m = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1")), ("a.png", bytearray(b"xx"))], "n string, c binary")
    assert [r[0] for r in m.select(files.magic_matches(F.col("n"), F.col("c"))).collect()] == [True, False]
    key = files.vault_key("pass", b"salt" * 4, 1000)
    box = files.sealed(m, "c", key)
    assert bytes(files.opened(box, "c", key).first().c) == b"%PDF-1"
    assert files.opened(box, "c", b"0" * 32).first().c is None


def test_office(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>138</w:t></w:r><w:r><w:t>12345678</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {(r.location, r.text, r.error is None) for r in text_units(spark, str(tmp_path)).collect()}
    assert ("word/document.xml", "13812345678", True) in got and len(got) == 2
