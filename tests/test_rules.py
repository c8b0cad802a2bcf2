"""Every rule on a value of its own kind, custom rules and their history, archives, media."""

import re

import pytest

#: A value for each pattern of a labelled rule that isn't a plain identifier.
VALUES = ["AB-123456", "110101900101123", "12345678901234567", "123456789012", "12/27", "2023", "12345", "李小明", "AA12345678901234567", "12345678-9", "1234567890", "￥1,234.50", "abc@host.example", "490154203237518", "89860012345678901234", "eyJhbGciOi.eyJzdWIi.abcdefghij", "host.example.com", "[30.123, 120.456]", "30.1234,120.4567", "北京市第一人民法院", "北京市人民检察院", "北京市公安局", "北京市看守所", "北京市监狱", "3栋2单元501室", "北京市海淀区中关村大街1号", "110101000001GB00001F00010001", "user=1;host=x;port=5", "壹佰元整", "1234567890123456", "490154203237518", "11"]


def test_labelled_rules():
    """Each labelled rule finds some value behind its first label, by the pattern that Spark is given."""
    from veilspark.plans.patterns import parsed, required
    from veilspark.plans.rules import BUILT_IN

    silent = []
    for r in BUILT_IN:
        labels = required(parsed(r.pattern)) if r.group and r.rule_id.startswith("CN_") and r.pattern.startswith("(?:") else None
        if labels and min(map(len, labels)) > 1:
            pattern = re.compile(r.regex.replace("(?iu)", "(?i)").replace(r"\p{IsHan}", "\u4e00-\u9fff"))
            if not any(pattern.search(f"{label}{tail}：{v}") for label in labels[:3] for v in VALUES for tail in ("", "号", "编号", "工号")):
                silent.append(r.rule_id)
    assert not silent
    assert len(BUILT_IN) == 201 and len({r.rule_id for r in BUILT_IN}) == 201


def test_gold(spark):
    from veilspark.operators.detect import matches

    gold = [
        ("护照号码：E12345678。", "CN_PASSPORT_CONTEXT", "E12345678"), ("牌照 京A12345 停放", "CN_LICENSE_PLATE", "京A12345"), ("合同编号：HT-2023-001", "CONTRACT_NUMBER", "HT-2023-001"),
        ("codice RSSMRA85T10A562S ok", "IT_CODICE_FISCALE", "RSSMRA85T10A562S"), ("personnummer: 811218-9876", "SE_PERSONNUMMER_CONTEXT", "811218-9876"), ("IRD number: 49091850", "NZ_IRD_CONTEXT", "49091850"),
        ("dob: 1990-01-05", "EN_DATE_OF_BIRTH", "1990-01-05"), ("ein 12-3456789", "US_EIN_CONTEXT", "12-3456789"), ("routing 021000021", "US_ABA_ROUTING", "021000021"), ("CVV：123", "CN_BANK_CARD_CVV_CONTEXT", "123"),
        ("审判长：李小明", "CN_JUDGE_CLERK_NAME_CONTEXT", "李小明"), ("月薪：￥12,000.00", "CN_SALARY_FIELD_CONTEXT", "￥12,000.00"), (r"see C:\Users\anna\x.txt", "WINDOWS_USER_PATH", r"C:\Users\anna\x.txt"),
    ]
    none = ["codice RSSMRA85T10A562T ok", "personnummer: 811218-9875", "IRD number: 49091851", "routing 021000022", "旧版身份证号 11010190133112X", ""]
    rows = [(i, t) for i, (t, _, _) in enumerate(gold)] + [(100 + i, t) for i, t in enumerate(none)]
    got = {(r.doc_id, r.rule_id, r.value) for r in matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missing = [(i, rule, v) for i, (_, rule, v) in enumerate(gold) if (i, rule, v) not in got]
    assert not missing
    assert not [x for x in got if x[0] >= 100 and x[1] in ("IT_CODICE_FISCALE", "SE_PERSONNUMMER_CONTEXT", "NZ_IRD_CONTEXT", "US_ABA_ROUTING")]


def test_many_matches(spark):
    from veilspark.operators.detect import matches
    from veilspark.plans.rules import RuleSet

    text = " ".join(f"user{i}@mail.example.com 10.0.{i % 250}.{i % 200}" for i in range(3000))
    got = matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), RuleSet().only("EMAIL_ADDRESS", "IPV4_ADDRESS", "URL")).collect()
    assert len(got) == 6000 and all(text[r.start : r.end] == r.value for r in got)


def test_custom_rules():
    from veilspark.plans.rules import History, RuleSet

    a = RuleSet().with_custom("badge", "employment", 70, r"B-\d{4}")
    b = a.with_changed("badge", "employment", 71, r"B-\d{5}").disable("CUSTOM_BADGE")
    assert b.custom[0].priority == 71 and RuleSet().imported(b.exported()).custom == b.custom
    assert not b.imported('[{"id": "x", "category": "c", "priority": 1, "regex": "x+"}]', replace_all=True).disabled
    with pytest.raises(ValueError):
        a.imported(a.exported())
    assert not b.without_custom("CUSTOM_BADGE").custom
    h = History()
    for i in range(25):
        h = h.saved(RuleSet(version=i))
    assert len(h.sets) == 20 and h.sets[0].version == 24 and h.rolled_back(10).sets[0].version == 25
    with pytest.raises(ValueError):
        h.rolled_back(1)


def test_safe_paths(spark):
    from veilspark.operators.reports import safe_path

    given = {"a/b.txt": True, "a/../b": True, "../b": False, "a/../../b": False, "/a": False, "C:/a": False, "con.txt": False, "a/lpt1": False, "a./b": False, "a /b": False, "": False, "a\\..\\..\\b": False, "./a": True, "x/con/../y": True}
    df = spark.createDataFrame([(k,) for k in given], "path string")
    assert {r.path: r.ok for r in df.select("path", safe_path(df["path"]).alias("ok")).collect()} == given
