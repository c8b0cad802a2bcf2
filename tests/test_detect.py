import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect as d
from veilspark.operators import reports as r
from veilspark.plans.patterns import parsed, required
from veilspark.plans.rules import RuleSet, check_custom, clean_list, custom_id


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


VALUES = [
    ("IBAN", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 31"),
    ("US_SSN", "123-45-6789", "666-45-6789"),
    ("US_ABA_ROUTING", "ABA routing number: 021000021", "ABA routing number: 021000022"),
    ("CANADA_SIN_CONTEXT", "SIN: 046 454 286", "SIN: 046 454 287"),
    ("UK_NINO", "AB 12 34 56 C", "BG 12 34 56 C"),
    ("UK_NHS_NUMBER_CONTEXT", "NHS number: 943 476 5919", "NHS number: 943 476 5918"),
    ("ES_DNI_NIE", "12345678Z", "12345678A"),
    ("NL_BSN_CONTEXT", "BSN: 111222333", "BSN: 111222334"),
    ("PL_PESEL_CONTEXT", "PESEL: 44051401458", "PESEL: 44051401459"),
    ("FI_HETU", "131052-308T", "131052-308U"),
    ("AU_TFN_CONTEXT", "TFN: 123 456 782", "TFN: 123 456 783"),
    ("SG_NRIC_FIN", "S1234567D", "S1234567A"),
    ("HK_IDENTITY_CARD", "A123456(3)", "A123456(4)"),
    ("TW_NATIONAL_ID", "A123456789", "A123456788"),
    ("IPV4_ADDRESS", "host 10.2.3.4", "host 999.2.3.4"),
    ("IPV6_ADDRESS", "at 2001:db8::1", "at 2026:08"),
    ("IMEI_CONTEXT", "IMEI: 490154203237518", "IMEI: 490154203237519"),
    ("BANK_CARD_NUMBER", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112"),
]


def test_validators(spark):
    rules = RuleSet().only(*(v[0] for v in VALUES))
    rows = texts(spark, *(t for v in VALUES for t in v[1:]))
    found = {(x.doc_id, x.rule_id) for x in d.matches(rows, rules).collect()}
    for i, (rule, _, _) in enumerate(VALUES):
        assert (2 * i, rule) in found, rule
        assert (2 * i + 1, rule) not in found, rule


def test_offsets_and_masks(spark):
    rules = RuleSet().only("EMAIL_ADDRESS", "CN_MOBILE_PHONE")
    rows = texts(spark, "😀 a.b@c.org, 13812345678", "13812345678", "", None)
    got = {x.doc_id: x for x in d.redact(rows, rules).collect()}
    assert [(x.start, x.end, x.value) for x in got[0].found] == [(2, 11, "a.b@c.org"), (13, 24, "13812345678")]
    assert got[0].redacted == "😀 ＊.＊@＊.＊＊＊, ＊＊＊＊＊＊＊＊＊＊＊"
    assert got[2].redacted == got[3].redacted == ""
    assert d.residual(d.redact(rows, rules).select("doc_id", "redacted"), rules).count() == 0


def test_overlaps_take_priority_then_length(spark):
    rules = RuleSet().only("URL", "EMAIL_ADDRESS").with_lists(black=["example"])
    rows = texts(spark, "see http://x.org/a@example.com now")
    assert [x.rule_id for x in d.matches(rows, rules).collect()] == ["BLACKLIST"]
    assert [x.rule_id for x in d.matches(rows, RuleSet().only("URL", "EMAIL_ADDRESS")).collect()] == ["EMAIL_ADDRESS"]
    white = RuleSet().only("URL", "EMAIL_ADDRESS").with_lists(white=["A@EXAMPLE.COM"])
    assert [x.rule_id for x in d.matches(rows, white).collect()] == ["URL"]


def test_pseudonyms(spark):
    rules = RuleSet().only("CN_MOBILE_PHONE")
    rows = texts(spark, "13812345678", "13812345678 x", "13912345678")
    a = [x.redacted for x in d.redact(rows, rules, key=b"one").orderBy("doc_id").collect()]
    b = [x.redacted for x in d.redact(rows, rules, key=b"two").orderBy("doc_id").collect()]
    assert a[0] == a[1][:11] and a[0] != a[2] and a[0] != b[0] and all(len(x) == len(y) for x, y in zip(a, b))
    own = spark.range(1).select(F.hex(d.hmac_sha256(b"key", F.lit(b"message")))).first()[0]
    assert own.lower() == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()


def test_required_texts():
    asked = lambda x: set(required(parsed(x)) or ())
    assert asked("(?i)(?:API[ _-]?Key|接口密钥)\\s*(x+)") == {"apikey", "api key", "api_key", "api-key", "接口密钥"}
    assert asked("(?:nhs number|nhs no\\.?)[0-9]+") == {"nhs number", "nhs no"}
    assert asked("(?:ab)?[0-9]{3}.") == set("0123456789") and asked(r"\p{L}+") == set() and asked("(?:ab)+c?") == {"ab"}


def test_rule_sets():
    s = RuleSet().with_custom("doc no", "business", 50, "DOC-[0-9]{6}")
    assert s.version == 1 and s.rules[-1].rule_id == "CUSTOM_DOC_NO" == custom_id("doc no")
    assert {r.category for r in RuleSet().categories("Financial").enabled} == {"financial"}
    assert clean_list([" a\t", "A", "b"]) == ("a", "b")
    for bad in ("(a+)+", "[0-9]*", "(?=a)b", r"(a)\1", ""):
        with pytest.raises(ValueError):
            check_custom(bad)
    with pytest.raises(ValueError):
        s.with_custom("doc no", "business", 50, "X")


def test_review_and_reports(spark):
    items = d.review(texts(spark, "a@b.org and c@d.org"), RuleSet().only("EMAIL_ADDRESS")).orderBy("item").collect()
    assert [(x.item, x.value, x.truncated) for x in items] == [(1, "a@b.org", False), (2, "c@d.org", False)]
    e = spark.createDataFrame([("1", "A", "x"), ("2", "A", "y")], "case_id string, rule_id string, value string")
    a = spark.createDataFrame([("1", "A", "x"), ("3", "A", "z")], e.schema)
    got = r.precision_recall(e, a).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall) == (1, 1, 1, 0.5, 0.5)
    f = spark.createDataFrame([("k", 0, 100), ("k", 900, 1000), ("k", 1801, 1900), ("k", 10, 20)], "key string, start_ms long, end_ms long")
    assert sorted((x.start_ms, x.end_ms) for x in r.consolidated(f, ["key"]).collect()) == [(0, 1000), (1801, 1900)]
    p = spark.createDataFrame([("a/b.docx",), ("../x.docx",), ("C:/x",), ("con.txt",), ("a.exe",), ("noext",)], "path string")
    assert [x[0] for x in p.select(r.archive_category(F.col("path"), F.lit(False))).collect()] == ["REDACTABLE", "DANGEROUS", "DANGEROUS", "DANGEROUS", "DANGEROUS", "UNKNOWN"]
    t = spark.createDataFrame([("call one three eight, 零 1",)], "t string")
    assert t.select(r.spoken_digits(F.col("t"))).first()[0] == "call 13801"


def test_parsers_and_stream(spark, tmp_path):
    import zipfile

    from veilspark.sources import parsers as p
    from veilspark.streaming.redaction import redact_stream

    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i> there\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n"
    cues = p.srt_cues(spark.createDataFrame([(1, srt)], "id long, text string"), "text", "id").collect()
    assert [(c.start_ms, c.end_ms, c.text) for c in cues] == [(1000, 2500, "Hi  there"), (3000, 4000, "Bye")]
    tsv = "level\tpage_num\n5\t1\t1\t1\t1\t1\t45\t10\t110\t20\t91.5\tword\nbroken"
    words = p.ocr_words(spark.createDataFrame([(1, tsv)], "id long, tsv string"), "tsv", "id").collect()
    assert [(w.left, w.width, w.conf, w.text) for w in words] == [(45, 110, 91.5, "word")]
    speech = '{"transcription":[{"text":"hi","offsets":{"from":100,"to":200},"tokens":[{"p":0.5},{"p":2}]}]}'
    seg = p.speech_segments(spark.createDataFrame([(1, speech)], "id long, j string"), "j", "id").first()
    assert (seg.start_ms, seg.end_ms, seg.confidence) == (0, 450, 0.5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "abc")
    (tmp_path / "b.bin").write_bytes(b"zzz")
    got = {(e.entry, e.path, e.size) for e in p.archive_entries(spark, str(tmp_path)).collect()}
    assert (0, "x/y.txt", 3) in got and (-1, None, -1) in got
    src = tmp_path / "in"
    texts(spark, "mail a@b.org").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    redact_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), RuleSet().only("EMAIL_ADDRESS")).awaitTermination(60)
    assert [x.redacted for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["mail ＊@＊.＊＊＊"]
