import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import files, jobs, media
from veilspark.plans.rules import RuleSet
from veilspark.sources import office, probes

PHONES = RuleSet().only("CN_MOBILE_PHONE")
W = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="w" xmlns:mc="m" mc:Ignorable="w14">'


def package(**parts):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(box.getvalue())


def part(content, name):
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        return z.read(name).decode()


def rewritten(spark, *contents, **options):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content binary")
    got = {r.path: r for r in office.redacted_packages(rows, options.pop("rules", PHONES), **options).collect()}
    return [got[str(i)] for i in range(len(contents))]


def test_word_packages(spark):
    body = W + '<w:p><w:r><w:t>call 138</w:t></w:r><!-- x --><w:r><w:t><![CDATA[1234]]>5678 &amp; more</w:t></w:r></w:p><w:p><w:r><w:t>plain &lt;</w:t></w:r></w:p><w:ins w:author="Ann"/></w:document>'
    rels = '<Relationships><Relationship Id="a" Target="http://x/?13812345678" TargetMode="External"/><Relationship Id="b" Target="c.xml"/></Relationships>'
    core = "<c:p xmlns:c='c' xmlns:d='d'><d:creator>Ann</d:creator><d:title>of 13812345678</d:title></c:p>"
    custom = '<P xmlns:vt="v"><property name="n"><vt:lpwstr>Ann</vt:lpwstr></property><property><vt:i4>7</vt:i4></property><property><vt:bool>true</vt:bool></property></P>'
    box = package(**{"word/document.xml": body, "word/_rels/document.xml.rels": rels, "docProps/core.xml": core, "docProps/custom.xml": custom, "docProps/thumbnail.jpeg": "x"})
    got = rewritten(spark, box)[0]
    assert got.error is None and got.changed == 2
    new = part(got.content, "word/document.xml")
    assert new == body.replace("call 138", "call ＊＊＊").replace("<![CDATA[1234]]>5678", "＊" * 8).replace('"Ann"', '"redacted"')
    assert part(got.content, "word/_rels/document.xml.rels") == rels.replace("http://x/?13812345678", "about:blank")
    assert part(got.content, "docProps/core.xml") == core.replace("Ann", "已脱敏").replace("13812345678", "＊" * 11)
    assert part(got.content, "docProps/custom.xml") == custom.replace(">Ann<", ">redacted<").replace(">7<", ">0<").replace("true", "false")
    assert part(got.content, "docProps/thumbnail.jpeg") == ""


def test_word_packages_with_pseudonyms(spark):
    got = rewritten(spark, package(**{"word/document.xml": W + "<w:p><w:t>13812345678</w:t></w:p></w:document>"}), key=b"k")[0]
    new = part(got.content, "word/document.xml")
    assert "13812345678" not in new and len(new) == len(W) + len("<w:p><w:t></w:t></w:p></w:document>") + 11


def test_sheets(spark):
    rows = '<worksheet><c r="A1" t="n"><v>13812345678</v></c><c r="A2"><v>5</v></c><c r="A3" t="s"><v>0</v></c><c r="A4" t="inlineStr"><is><t>13812345678</t></is></c><c r="A5" t="str"><f>A1</f><v>13812345678</v></c><oddHeader>13812345678</oddHeader></worksheet>'
    sheet = lambda text: {"xl/worksheets/sheet1.xml": text}
    names = '<workbook><sheets><sheet name="{}"/></sheets></workbook>'
    good, formula, titled = rewritten(
        spark,
        package(**sheet(rows), **{"xl/workbook.xml": names.format("one"), "xl/sharedStrings.xml": "<sst><si><r><t>13812</t></r><r><t>345678</t></r></si></sst>"}),
        package(**sheet('<worksheet><c><f>LEN("13812345678")</f><v>11</v></c></worksheet>')),
        package(**{"xl/workbook.xml": names.format("13812345678")}),
    )
    new = part(good.content, "xl/worksheets/sheet1.xml")
    assert '<c r="A1" t="str"><v>00000000000</v>' in new and '<c r="A2"><v>5</v>' in new and '<c r="A3" t="s"><v>0</v>' in new and "1381" not in new
    assert part(good.content, "xl/sharedStrings.xml") == "<sst><si><r><t>＊＊＊＊＊</t></r><r><t>＊＊＊＊＊＊</t></r></si></sst>"
    assert formula.error == titled.error == "a formula or a sheet's name holds a value" and formula.content is None


@pytest.mark.parametrize("name", ["word/embeddings/a.bin", "word/vbaProject.bin", "_xmlsignatures/s.xml", "word/media/a.png", "../a.xml"])
def test_refused_packages(spark, name):
    got = rewritten(spark, package(**{name: "<a/>"}))[0]
    assert got.content is None and got.error


def test_broken_packages(spark):
    doctype = package(**{"word/document.xml": "<!-- " + "x" * 9000 + " --><!DOCTYPE a><a/>"})
    nothing, broken, typed, utf16, bare = rewritten(spark, None, bytearray(b"no zip"), doctype, package(**{"word/a.xml": "<?xml version='1.0' encoding='gbk'?><a/>"}), package(), keep_pictures=True)
    assert all(x.content is None for x in (nothing, broken, typed, utf16)) and bare.error is None and bare.changed == 0
    assert typed.error == "a part declares a document type"
    none = spark.createDataFrame([], "path string, content binary")
    assert office.redacted_packages(none, PHONES).count() == 0


def test_probes(spark):
    stream = {"index": 0, "codec_type": "Video", "codec_name": "H264", "width": 640, "height": 480, "avg_frame_rate": "30/0", "duration": "N/A"}
    rows = [
        ("ok.mp4", json.dumps({"format": {"duration": "1.2345"}, "streams": [stream | {"avg_frame_rate": "25/1"}, {"index": 1, "codec_type": "subtitle"}]})),
        ("a.mp3", json.dumps({"format": {}, "streams": [{"index": 1, "codec_type": "audio", "duration": "2"}, {"index": 2, "codec_type": "audio", "sample_rate": "48000"}]})),
        ("b.mkv", json.dumps({"format": {"duration": "5"}, "streams": [stream, stream | {"disposition": {"attached_pic": 1}}]})),
        ("c.wav", "{"),
        ("d.wav", None),
    ]
    got = {r.name: r for r in probes.probed(spark.createDataFrame(rows, "name string, j string"), "j", "name", name="name").collect()}
    assert (got["ok.mp4"].duration_ms, got["ok.mp4"].problems, got["ok.mp4"].streams[0].fps) == (1235, [], 25.0)
    assert (got["a.mp3"].duration_ms, got["a.mp3"].problems, got["a.mp3"].streams[1].sample_rate) == (2000, ["several audio streams"], 48000)
    assert got["b.mkv"].problems == ["frame rate"] and got["b.mkv"].streams[0].fps == -1
    assert "no streams" in got["c.wav"].problems and "no streams" in got["d.wav"].problems
    rate = spark.range(1).select(*(probes.sample_rate(F.lit(ms)) for ms in (-1, 60_000, 1_800_000, 10**9))).first()
    assert list(rate) == [1.0, 1.0, 0.5, 0.1]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 5)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x02\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 9
    rows = [("png", png), ("jpeg", jpeg), ("bmp", b"BM" + b"\0" * 16 + struct.pack("<ii", 4, -6)), ("gif", b"GIF89a" + struct.pack("<HH", 2, 8)), ("huge", png[:16] + struct.pack(">II", 32768, 32768)), ("none", b"x"), ("null", None)]
    got = {r.path: (r.format, r.width, r.height, r.allowed) for r in probes.image_sizes(spark.createDataFrame([(a, bytearray(b) if b is not None else None) for a, b in rows], "path string, content binary")).collect()}
    assert got == {"png": ("png", 3, 5, True), "jpeg": ("jpeg", 9, 7, True), "bmp": ("bmp", 4, 6, True), "gif": ("gif", 2, 8, True), "huge": ("png", 32768, 32768, False), "none": (None, None, None, False), "null": (None, None, None, False)}


def test_regions(spark):
    found = [{"type": "Face", "bbox": [0, 0, 100.5, 200], "label": "a\nb", "confidence": 2}, {"type": "cat", "bbox": [0, 0, 10, 10]}, {"type": "face", "bbox": [0, 0, 10]}, {"type": "face", "bbox": [0, 0, 1000, 900]}, {"type": "qr_code", "bbox": [990, 990, 1000, 1000]}]
    df = spark.createDataFrame([(1, json.dumps({"findings": found}), 200, 100), (2, None, 5, 5)], "id int, j string, w int, h int")
    got = [tuple(r) for r in probes.model_regions(df, "j", "w", "h", "id").collect()]
    assert got == [(1, 0, "face", "a b", 0, 0, 21, 20, 1.0, False)]


def test_jobs(spark):
    text = lambda job, **more: "\n".join(["# c", f"id={job}", "status:COMPLETED", *(f"{k} = {v}" for k, v in more.items())])
    rows = [
        ("/d/a", text("a", inputPath="/d/a/original/x\\=y", note="1\\n2", outputPath="/d/a/output/o")),
        ("/d/b/", text("c", inputPath="/d/b/original/x")),
        ("/d/e", text("e", inputPath="/d/e/original/../../x")),
        ("/d/f", text("f", inputPath="/d/f/original/x", vaultPath="/etc/x")),
        ("/d/g", text("g")),
        ("/d/h", None),
    ]
    got = {r.folder: r for r in jobs.job_states(spark.createDataFrame(rows, "folder string, t string"), "folder", "t", "folder").collect()}
    assert [got[k].corrupt for k, _ in rows] == [False, True, True, True, True, True]
    assert got["/d/a"].properties["inputPath"] == "/d/a/original/x=y" and got["/d/a"].properties["note"] == "1\n2"
    asked = [("a", 10, True), ("a", 1, False), ("b", 89, False), ("c", 91, False), (None, 1, False), (" ", 1, False), ("d", -1, False)]
    room = jobs.reservations(spark.createDataFrame(asked, "owner string, bytes long, held boolean"), 1, 101)
    assert {(r.owner, r.bytes): r.refused for r in room.collect()} == {("a", 1): "holds room already", ("b", 89): None, ("c", 91): "no room left", (None, 1): "no owner", (" ", 1): "no owner", ("d", -1): "no valid size"}


def test_job_history(spark, tmp_path):
    for job in ("a", "b"):
        (tmp_path / job).mkdir()
        (tmp_path / job / "job.properties").write_text(f"id={job}\nstatus=FAILED\ninputPath={tmp_path}/a/original/x\n")
    assert [r.id for r in jobs.job_history(spark, str(tmp_path)).collect()] == ["a"]


def test_ignored_findings(spark):
    rows = [("AUDIO", 1, 150, 299, 4, 8, 12, 16, "Name"), ("AUDIO", 2, 150, 299, 4, 8, 12, 16, "other"), ("VISUAL", 1, 0, 9, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "kind string, stream int, start_ms long, end_ms long, x int, y int, w int, h int, value string")
    ignored = spark.createDataFrame([("media:AUDIO:2:1:2:1:2:3:4",), ("NAME",), (None,), (" ",)], "value string")
    assert [r.kind for r in media.not_ignored(df, ignored).collect()] == ["VISUAL"]


def test_paths(spark):
    df = spark.createDataFrame([("a\\13812345678\\tel_13812345678.txt",), ("x//CON",), (None,)], "p string")
    got = {r.p: r.new_path for r in files.redacted_paths(df, "p", PHONES).collect()}
    assert got == {"a\\13812345678\\tel_13812345678.txt": "a/REDACTED/tel_REDACTED.txt", "x//CON": "x//_CON"}
