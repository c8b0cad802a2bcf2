"""What is read from patterns, against matches made from their trees and against known answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect as d
from veilspark.plans import patterns as p
from veilspark.plans.prefilter import LIKE, gate, prefilter, trie
from veilspark.plans.rules import Rule, RuleSet, check_custom


@pytest.mark.parametrize(
    ("pattern", "kind"),
    [
        ("(a+)+", "exponential"), ("(a|aa)+$", "exponential"), ("(a*)*b", "exponential"), ("(a?b?)*c", "exponential"), (r"(\d+\.?)+", "exponential"), ("(?:x|[a-z])+!", "exponential"),
        ("a*a*b", "polynomial"), ("x.*y.*z", "polynomial"), (r"\d+-?\d+", "polynomial"), ("(?i)[A-C]+c+", "polynomial"), (r"\p{L}+\p{IsHan}+", "polynomial"),
        ("[A-Z]{2}-[0-9]+", None), (r"\p{L}{3}-\d+", None), (r"\w+@\w+\.com", None), ("(a|b)*c(a|b)*", None), (r"(?:\d+,)*\d+", None), ("a{2,5}a+b", None), ("[a-z&&[^aeiou]]+[aeiou]+", None), (r"\Qa+\E+b", None),
    ],
)
def test_ambiguity(pattern, kind):
    assert p.ambiguity(p.parsed(pattern)) == kind


@pytest.mark.parametrize("pattern", ["(", "a)", "[a", "*a", "a{3,2}", r"\p{NoSuchClass}", r"\1", r"\y", "(?<n>a)(?<n>b)", "[z-a]", "(?~a)"])
def test_no_patterns(pattern):
    with pytest.raises(ValueError, match=r".+"):
        p.parsed(pattern)


@pytest.mark.parametrize("pattern", ["", "a" * 501, "[0-9]*", "^", "(?=secret)secret", r"(secret)\1", "(?<!a)b", "(a+)+", "a*a*b", "(a|aa)+$", "("])
def test_refused_custom_patterns(pattern):
    with pytest.raises(ValueError, match=r".+"):
        check_custom(pattern)


def test_accepted_custom_patterns():
    for pattern in (r"\p{L}{3}-\d+", r"(?i)case-[0-9]{3,8}", r"\Q[x]\E\d", "ONE-[0-9]+", r"[\p{IsHan}&&[^的]]{2,4}号", r"\x{6c49}\u5b57"):
        check_custom(pattern)
        assert RuleSet().with_custom("own", "custom", 5, pattern).custom[0].pattern == pattern


def made(tree, r):
    """A text that a pattern matches, but for what it looks at around."""
    if isinstance(tree, p.One):
        own = [c for c in (*tree.letters.points, *(tree.letters.whole or ()), *r.sample(p.SAMPLE, 300), *range(33, 127)) if tree.letters.holds(c)]
        return chr(r.choice(own or [c for c in range(0x110000) if tree.letters.holds(c)]))
    if isinstance(tree, p.Row):
        return "".join(made(x, r) for x in tree.parts)
    if isinstance(tree, p.Either):
        return made(r.choice(tree.parts), r)
    if isinstance(tree, p.Again):
        high = tree.low + 2 if tree.high is None else tree.high
        return "".join(made(tree.part, r) for _ in range(r.randint(tree.low, min(high, tree.low + 3))))
    return ""


def test_every_match_passes_its_gate():
    """Matches of all rules hold what the prefilter asks for, whatever stands around them."""
    r = random.Random(8)
    rules = RuleSet().enabled
    own = prefilter(tuple(x.regex for x in rules))
    words = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), own.pattern))
    for i, rule in enumerate(rules):
        tree, g = p.parsed(rule.regex), gate(rule.regex)
        for _ in range(25):
            text = r.choice(["", "x", "号 9", "Ein "]) + made(tree, r) + r.choice(["", "y", "12", "¥"])
            low = text.translate(str.maketrans(*LIKE)).lower()
            assert sum(c in "0123456789" for c in text) >= g.digits, (rule.rule_id, text)
            if g.texts:
                held = {j for m in words.finditer(low) for j in own.holders[m[1]]} | {j for x, js in own.letters.items() if x in low for j in js}
                assert i in held, (rule.rule_id, text, g.texts)
            if g.window:
                plain = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", g.window)
                assert re.search(plain, text), (rule.rule_id, text, g.window)


def test_trie_takes_the_longest_word_at_each_place():
    r = random.Random(2)
    words = ["pass", "passport", "port", "sport", "身份", "身份证号", "份证", "a.b", "a", "aa"] + ["".join(r.choice("abc号") for _ in range(r.randint(2, 5))) for _ in range(60)]
    found = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), trie(words)))
    for _ in range(50):
        text = "".join(r.choice(["passport", "身份证号", "a.b", "c", "a", "b", "号", "-"]) for _ in range(30))
        want = [(i, max((w for w in words if text.startswith(w, i)), key=len, default=None)) for i in range(len(text))]
        assert [(m.start(), m[1]) for m in found.finditer(text)] == [x for x in want if x[1]]


def test_rules_with_few_gates_find_the_same(spark):
    """Rules run by themselves and with all others; a text with every kind of match, letters that count as ASCII among them."""
    texts = ["PAſSPORT: E12345678, ıban DE89370400440532013000", "mac 00:1a:2B:3c:4D:5e or 001a.2b3c.4d5e", "京A12345 贵州 粤Z9F27K 车", "VIN 1HGCM82633A004352 chassis", "91350100M000100Y43 code", "", None, "no values at all", "K" * 40 + " 192.168.10.1 a@b.example"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = RuleSet()
    every = {(x.doc_id, x.rule_id, x.start, x.value) for r in d.candidates(df, rules, out="c").select("doc_id", F.explode("c").alias("x")).collect() for x in [r.x.__class__(**(r.x.asDict() | {"doc_id": r.doc_id}))]}
    alone = set()
    for rule_id in ("IBAN", "MAC_ADDRESS", "MAC_ADDRESS_DOTTED", "CN_LICENSE_PLATE", "VEHICLE_IDENTIFICATION_NUMBER", "CN_UNIFIED_SOCIAL_CREDIT_CODE", "IPV4_ADDRESS", "EMAIL_ADDRESS", "PASSPORT_NUMBER"):
        rows = d.candidates(df, rules.only(rule_id), out="c").select("doc_id", F.explode("c").alias("x")).select("doc_id", "x.rule_id", "x.start", "x.value").collect()
        alone |= {tuple(r) for r in rows}
    ids = {x[1] for x in alone}
    assert alone == {x for x in every if x[1] in ids} and len(ids) >= 8


def test_tried_patterns(spark):
    df = spark.createDataFrame([(1, "case-123 and CASE-77"), (2, "case-1 " * 300), (3, None), (4, "x" * 20_001)], "id int, text string")
    got = {r.id: r.matches for r in d.tried(df, "case-[0-9]+").collect()}
    assert [tuple(x) for x in got[1]] == [(0, 8, "case-123", "case-123 and CASE-77"), (13, 20, "CASE-77", "case-123 and CASE-77")]
    assert len(got[2]) == 100 and got[2][99].start == 693 and got[2][99].context == ("case-1 " * 300)[669:723]
    assert got[3] == [] and got[4] is None
    with pytest.raises(ValueError, match="ways"):
        d.tried(df, "(a|aa)+$")


def test_rules_of_any_pattern_run(spark):
    """A pattern that isn't read here is left to the matcher, without a gate."""
    rules = RuleSet(rules=(Rule("ODD", "custom", 5, r"(?<=\$)\d{2}(?!\w)"), Rule("QUOTES", "custom", 4, r"it's \\ \Q${x}\E")))
    df = spark.createDataFrame([(1, "pay $42 now, it's \\ ${x}")], "doc_id int, text string")
    assert [(r.rule_id, r.value) for r in d.matches(df, rules).orderBy("start").collect()] == [("ODD", "42"), ("QUOTES", "it's \\ ${x}")]
