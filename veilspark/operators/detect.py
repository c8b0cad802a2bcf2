"""Detection and rewriting of sensitive values, as native Column expressions.

A rule's matches come from regexp_extract_all, their offsets from the lengths of what `split` leaves between them; no
Python runs on rows. One look at a text tells which rules may match it (`plans.prefilter`); these are run as data, their patterns
come from an array of rules, so a plan has the same few expressions for any number of rules. Candidates of all rules are sorted by priority, then length, then place, then the rule's order, and
taken greedily as long as they don't overlap. Only candidates of one group of overlaps are compared with each other, and
offsets are running sums over blocks, so a text with many values costs little more than its length. Offsets count code points from 0.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.constants import ints, strings
from veilspark.functions.validators import Keywords, always
from veilspark.plans.prefilter import LIKE, prefilter
from veilspark.plans.rules import Rule, RuleSet, check_custom

BLOCK = 64
CODE_RULE = "CN_ADMIN_DIVISION_CODE_CONTEXT"
#: Words that stand for what was taken out.
GONE = ("已脱敏", "redacted")
#: What masks a letter or digit; which characters are masked.
MASK = "＊"
MASKED = r"[\p{L}\p{Nd}\p{IsHan}&&[\x{0}-\x{FFFF}]]"
SPAN = "struct<p:int,l:int,start:int,ord:int,end:int,rule_id:string,category:string,priority:int,value:string>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an int array what `join` (a sum or a maximum, over numbers from 0 up) makes of it and all before it.

    Blocks are joined first, so a place looks back over its block only."""

    def upto(v: Column, blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), join))
        at = lambda i: (i / BLOCK).cast("int")
        return let(before, lambda p: F.transform(v, lambda _, i: F.aggregate(F.slice(v, at(i) * BLOCK + 1, i % BLOCK + 1), F.get(p, at(i)), join)))

    def of(v: Column) -> Column:
        last = F.greatest(((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), join))
        return let(blocks, lambda x: upto(v, x))

    return let(values, of)


def _kinds(enabled: list[Rule]) -> dict[object, int]:
    """A number for each validator but those of keywords, whose words are data; 0: none needed."""
    own = dict.fromkeys(r.valid for r in enabled if r.valid is not always and not isinstance(r.valid, Keywords))
    return {always: 0} | {f: i + 1 for i, f in enumerate(own)}


class _Rules:
    """The rules as constant arrays, read by a rule's place."""

    def __init__(self, enabled: list[Rule]) -> None:
        self.enabled, self.n, self.filter = enabled, len(enabled), prefilter(tuple(r.regex for r in enabled))
        kinds, gates = _kinds(enabled), self.filter.gates
        words = [r.valid if isinstance(r.valid, Keywords) else None for r in enabled]
        self.texts = {"rule_id": [r.rule_id for r in enabled], "category": [r.category for r in enabled], "regex": [r.regex for r in enabled], "near": [w.pattern if w else "" for w in words]}
        self.numbers = {"priority": [r.priority for r in enabled], "part": [r.group for r in enabled], "digits": [g.digits for g in gates], "free": [not g.texts and not g.window for g in gates], "kind": [-1 if w else kinds[r.valid] for r, w in zip(enabled, words, strict=True)], "reach": [w.reach if w else 0 for w in words]}

    def get(self, name: str, ord: Column) -> Column:
        return F.get(strings(self.texts[name]) if name in self.texts else ints(self.numbers[name]), ord)


def _possible(body: Column, low: Column, rules: _Rules) -> Column:
    """Which rules' texts or windows are held, by their places."""
    p, none = rules.filter, F.array().cast("array<int>")
    parts = [none]
    if p.pattern:
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(p.pattern), F.lit(1)))
        holders = F.map_from_arrays(strings(p.holders), strings(",".join(map(str, own)) for own in p.holders.values()))
        parts.append(F.flatten(F.transform(words, lambda w: F.split(F.element_at(holders, w), ",").cast("array<int>"))))
    parts += [F.when(low.contains(x), ints(own)).otherwise(none) for x, own in p.letters.items()]
    parts += [F.when(body.rlike(x), ints(own)).otherwise(none) for x, own in p.windows.items()]
    return F.array_distinct(F.concat(*parts))


def _hits(body: Column, rules: _Rules) -> Column:
    """The rules that match a text, with their matches, values and what stands between."""
    plain = F.when(body.rlike(f"[{LIKE[0]}]"), F.translate(body, *LIKE)).otherwise(body)
    # bound by `let`, for what a lambda uses would be put into it, and be worked out for each rule
    facts = F.struct(let(F.lower(plain), lambda low: _possible(body, low, rules)).alias("held"), F.length(F.regexp_replace(body, "[^0-9]+", "")).alias("digits"))
    may = let(facts, lambda f: F.filter(ints(range(rules.n)), lambda i: (rules.get("digits", i) <= f["digits"]) & ((rules.get("free", i) == 1) | F.array_contains(f["held"], i))))
    found = F.filter(F.transform(may, lambda i: F.struct(i.alias("ord"), F.regexp_extract_all(body, rules.get("regex", i), F.lit(0)).alias("whole"))), lambda h: F.size(h["whole"]) > 0)
    return F.transform(
        found,
        lambda h: F.struct(
            h["ord"].alias("ord"),
            *(rules.get(c, h["ord"]).alias(c) for c in ("priority", "rule_id", "category")),
            h["whole"].alias("whole"),
            F.when(rules.get("part", h["ord"]) == 0, h["whole"]).otherwise(F.regexp_extract_all(body, rules.get("regex", h["ord"]), rules.get("part", h["ord"]))).alias("value"),
            F.split(body, rules.get("regex", h["ord"]), -1).alias("between"),
        ),
    )


def _spans(hit: Column) -> Column:
    """The spans of one rule's matches, from what stands between them."""
    sizes = F.zip_with(hit["whole"], F.slice(hit["between"], F.lit(1), F.size(hit["whole"])), lambda x, y: F.length(x) + F.length(y))

    def span(v: Column, end: Column) -> Column:
        return F.struct((-hit["priority"]).alias("p"), (-F.length(v)).alias("l"), (end - F.length(v)).alias("start"), hit["ord"].alias("ord"), end.alias("end"), hit["rule_id"].alias("rule_id"), hit["category"].alias("category"), hit["priority"].alias("priority"), v.alias("value"))

    return F.zip_with(hit["value"], running(sizes, lambda a, b: a + b), span)


def _valid(x: Column, text: Column, rules: _Rules, white: tuple[str, ...]) -> Column:
    """Whether a span's rule accepts it, and the white list doesn't hold it."""
    value, ord = x["value"], x["ord"]

    def own(kind: Column) -> Column:
        out = F.when(kind == 0, always(value)).when(kind == -1, F.rlike(F.lower(Keywords.around(text, x["start"], x["end"], rules.get("reach", ord))), rules.get("near", ord)))
        for f, number in _kinds(rules.enabled).items():
            if number:
                out = out.when(kind == number, f(value, text, x["start"], x["end"]))
        return out

    good = (x["end"] > x["start"]) & F.coalesce(let(rules.get("kind", ord), own), F.lit(False))
    return good & ~F.array_contains(strings(w.lower() for w in white), F.lower(value)) if white else good


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _black(text: Column, term: str, order: int) -> Column:
    """Every place of a black-listed term, at priority 1000."""
    between = F.split(text, "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    n = len(term)

    def span(end: Column) -> Column:
        return F.struct(F.lit(-1000).alias("p"), F.lit(-n).alias("l"), (end - n).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit("BLACKLIST").alias("rule_id"), F.lit("custom").alias("category"), F.lit(1000).alias("priority"), F.lit(term).alias("value"))

    sizes = F.transform(F.slice(between, F.lit(1), F.size(between) - 1), lambda x: F.length(x) + n)
    return F.when(text.contains(term), F.transform(running(sizes, lambda a, b: a + b), span))


#: Input up to so many bytes a core, as the optimizer sees it, is dealt over all cores before patterns run.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, if it is small: a file with one row group would be one task, and patterns cost far more than a shuffle of so little."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size <= SMALL * cores else df


def _candidates(body: Column, rules: RuleSet) -> Column:
    spans = _none()
    if rules.enabled:
        own = _Rules(rules.enabled)
        spans = F.filter(F.flatten(F.transform(_hits(body, own), _spans)), lambda x: _valid(x, body, own, rules.whitelist))
    black = [F.coalesce(_black(body, t, 10_000 + i), _none()) for i, t in enumerate(rules.blacklist)]
    every = F.concat(F.coalesce(spans, _none()).cast(f"array<{SPAN}>"), *black)
    return F.coalesce(every, _none())


def candidates(df: DataFrame, rules: RuleSet, text: str = "text", out: str = "candidates") -> DataFrame:
    """`df` with an array of all valid candidates; a null or empty text has none."""
    return df.select(*df.columns, _candidates(F.col(text), rules).alias(out))


def selected(spans: Column) -> Column:
    """The greedy choice of spans that don't overlap, in order of place."""

    def take(chosen: Column, x: Column) -> Column:
        clash = F.exists(chosen, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(x)))

    def greedy(part: Column) -> Column:
        chosen = F.aggregate(F.array_sort(part), F.array().cast(f"array<{SPAN}>"), take)
        return F.when(F.size(part) < 2, part).otherwise(F.array_sort(chosen, lambda a, b: a["start"] - b["start"]))

    def grouped(x: Column, reach: Column) -> Column:
        # a group begins where all spans before it have ended
        begin = F.filter(F.transform(x, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return let(begin, lambda b: F.flatten(F.transform(b, lambda i, g: greedy(F.slice(x, i + 1, F.coalesce(F.get(b, g + 1), F.size(x)) - i)))))

    def placed(x: Column) -> Column:
        return let(running(F.transform(x, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda reach: grouped(x, reach))

    by_place = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    return F.when(F.size(spans) < 2, spans).otherwise(let(by_place, placed))


def detect(df: DataFrame, rules: RuleSet | None = None, text: str = "text", out: str = "found") -> DataFrame:
    """`df` with the array `out` of the values found in `text`."""
    return candidates(df, rules or RuleSet(), text, out).withColumn(out, selected(F.col(out)))


def detect_with_lexicon(df: DataFrame, lexicon: DataFrame, rules: RuleSet | None = None, key: str = "doc_id", text: str = "text", out: str = "found") -> DataFrame:
    """`detect` with the place names of a lexicon (level, code, name) among the candidates, under the same white list and
    switches; division codes count only if the lexicon has them. `key` tells the rows of `df` apart."""
    from veilspark.operators.lexicon import LEVELS, places

    rules = rules or RuleSet()
    found = candidates(df, rules, text, "_c")
    codes = found.select(key, F.explode_outer(F.filter("_c", lambda x: x["rule_id"] == CODE_RULE)).alias("x")).select(key, "x.start", F.regexp_replace("x.value", "[^0-9]", "").alias("code")).where("code <> ''")
    known = codes.join(lexicon.select(F.col("code").cast("string").alias("code")).distinct(), "code").groupBy(key).agg(F.collect_set("start").alias("_known"))
    on = [level for level, (rule_id, _) in LEVELS.items() if rule_id not in rules.disabled]
    pick = lambda i: F.element_at(F.map_from_arrays(F.array(*map(F.lit, LEVELS)), F.array(*(F.lit(v[i]) for v in LEVELS.values()))), F.col("level"))
    named = places(df.select(key, text), lexicon, key, text).where(F.col("level").isin(*on))
    if rules.whitelist:
        named = named.where(~F.lower("name").isin(*[w.lower() for w in rules.whitelist]))
    size = F.length("name")
    span = F.struct((-pick(1)).alias("p"), (-size).alias("l"), F.col("start"), F.lit(9_000).alias("ord"), F.col("end"), pick(0).alias("rule_id"), F.lit("geography_location").alias("category"), pick(1).alias("priority"), F.col("name").alias("value"))
    held = named.groupBy(key).agg(F.collect_list(span.cast(SPAN)).alias("_places"))
    joined = found.join(known, key, "left").join(held, key, "left")
    good = F.filter("_c", lambda x: (x["rule_id"] != CODE_RULE) | F.coalesce(F.array_contains("_known", x["start"]), F.lit(False)))
    every = F.concat(good, F.coalesce("_places", _none()))
    return joined.withColumn(out, every).drop("_c", "_known", "_places").withColumn(out, selected(F.col(out)))


def matches(df: DataFrame, rules: RuleSet | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text", overlapping: bool = False) -> DataFrame:
    """A row for each value found: keys, rule_id, category, priority, start, end, value. `overlapping`: also for each valid
    value that gives way to one of another rule."""
    find = candidates if overlapping else detect
    found = find(spread(df.select(*keys, text)), rules or RuleSet(), text, "found")
    # the outer form, since for the other one the optimizer adds a filter that detects everything again
    found = found.select(*keys, F.explode_outer("found").alias("x")).where("x IS NOT NULL")
    return found.select(*keys, *(F.col(f"x.{c}").alias(c) for c in ("rule_id", "category", "priority", "start", "end", "value")))


def mask(value: Column) -> Column:
    return F.regexp_replace(value, MASKED, MASK)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a binary column, from two sha2 calls; the padded key is made once."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256))


def pseudonym(key: bytes):
    """A replacement of equal length and shape that depends on the key, the rule and the value."""
    # The characters that stand for Han characters.
    han = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥春夏秋冬东南西北中"

    def of(value: Column, rule_id: Column) -> Column:
        code = F.hex(hmac_sha256(key, F.concat(F.encode(rule_id, "utf-8"), F.lit(b"\0"), F.encode(value, "utf-8"))))

        def one(c: Column, i: Column) -> Column:
            b = F.conv(F.substring(code, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda letters: F.get(F.array(*map(F.lit, letters)), b % len(letters))
            return (
                F.when(c.rlike("^[0-9]$"), pick("0123456789"))
                .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike(r"^\p{IsHan}$"), pick(han))
                .when(c.rlike(r"^[\p{L}\p{Nd}]$"), F.lit(MASK))
                .otherwise(c)
            )

        made = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")
        return let(made, lambda x: F.when(x == value, _differing(x)).otherwise(x))

    return of


def _differing(value: Column) -> Column:
    """`value` with its first digit raised by one or its first letter replaced, whichever comes first."""
    first = F.regexp_extract(value, r"[0-9]|\p{L}|\p{IsHan}", 0)
    other = F.when(first.rlike("[0-9]"), ((F.coalesce(first.try_cast("int"), F.lit(0)) + 1) % 10).cast("string")).otherwise("甲")
    at = F.instr(value, first)
    return F.when(first == "", value).otherwise(F.concat(F.substring(value, F.lit(1), at - 1), other, F.substring(value, at + 1, F.length(value))))


def project_key(master: bytes, project: str, label: str = "veilspark/project/v1") -> bytes:
    """The key by which one project's values are replaced."""
    return hmac.new(master, label.encode() + b"\0" + project.strip().encode(), hashlib.sha256).digest()


def rewritten(text: Column, found: Column, replace) -> Column:
    """`text` with each span's value replaced; `replace` takes (value, rule_id)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def step(a: Column, x: Column) -> Column:
        return F.struct(F.concat(a["out"], F.substring(text, a["pos"] + 1, x["start"] - a["pos"]), replace(x["value"], x["rule_id"])).alias("out"), x["end"].alias("pos"))

    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


#: A masked value can free its neighbour: digits before an address make no card number until the address is masked. So many passes are made.
MOST_PASSES = 8


def redact(df: DataFrame, rules: RuleSet | None = None, text: str = "text", key: bytes | None = None, out: str = "redacted", passes: int = 1) -> DataFrame:
    """`df` with `text` masked, or with keyed pseudonyms, in `out`; a null text becomes empty. `found` has what the first
    pass finds. Each further pass looks at the texts that the pass before it changed."""
    rules, replace = rules or RuleSet(), (lambda v, r: mask(v)) if key is None else pseudonym(key)
    new = lambda body, found: F.when(F.size(found) > 0, rewritten(body, found, replace)).otherwise(body)
    seen = detect(df, rules, text).withColumn(out, new(F.coalesce(F.col(text), F.lit("")), F.col("found")))
    if passes < 2:
        return seen

    def again(a: Column, _: Column) -> Column:
        more = let(_candidates(a["text"], rules), selected)
        return F.when(a["go"], let(more, lambda m: F.struct(new(a["text"], m).alias("text"), (F.size(m) > 0).alias("go")))).otherwise(a)

    start = F.struct(F.col(out).alias("text"), F.lit(True).alias("go"))
    rest = F.aggregate(F.sequence(F.lit(2), F.lit(passes)), start, again, lambda a: a["text"])
    return seen.withColumn(out, F.when(F.size("found") > 0, rest).otherwise(F.col(out)))


def residual(df: DataFrame, rules: RuleSet | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "redacted") -> DataFrame:
    """Values still found in rewritten text that hold an unmasked letter or digit; the words that stand for what was taken out are none."""
    left = matches(df, rules, keys, text).where((F.col("value") != GONE[0]) & (F.lower("value") != GONE[1]))
    return left.where(F.col("value").rlike(r"[\p{L}\p{Nd}\p{IsHan}&&[^＊]]"))


#: The longest text a rule is tried on, matches shown of it, and what is shown around them.
TRIED, SHOWN, AROUND = 20_000, 100, 24


def tried(df: DataFrame, pattern: str, text: str = "text", out: str = "matches") -> DataFrame:
    """`df` with what a user's pattern matches in each text, in `out`: start, end, value and context of the first matches; null for a text that is too long."""
    check_custom(pattern)
    rule, body = Rule("TRIED", "custom", 0, pattern, 0, True), F.coalesce(F.col(text), F.lit(""))
    whole = F.regexp_extract_all(body, F.lit(rule.regex), F.lit(0))
    hit = F.struct(F.lit(0).alias("ord"), F.lit(0).alias("priority"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"), whole.alias("whole"), whole.alias("value"), F.split(body, rule.regex, -1).alias("between"))
    low = lambda x: F.greatest(x["start"] - AROUND, F.lit(0))
    shown = F.transform(F.slice(let(hit, _spans), 1, SHOWN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.substring(body, low(x) + 1, x["end"] + AROUND - low(x)).alias("context")))
    return df.withColumn(out, F.when(F.length(body) <= TRIED, shown))


def context(text: Column, start: Column, end: Column, reach: int = 24) -> Column:
    low = F.greatest(start - reach, F.lit(0))
    return F.regexp_replace(F.substring(text, low + 1, end + reach - low), r"[\x00-\x1f]", " ")


def review(df: DataFrame, rules: RuleSet | None = None, key: str = "doc_id", text: str = "text", most: int = 5000) -> DataFrame:
    """The items a person reviews in each text: numbered by place, with context; `most` of a text, and whether there are more."""
    found = detect(df.select(key, text), rules, text).withColumn("truncated", F.size("found") > most)
    rows = found.select(key, text, "truncated", F.posexplode(F.slice("found", 1, most)).alias("i", "x"))
    return rows.select(key, (F.col("i") + 1).alias("item"), "x.rule_id", "x.start", "x.end", "x.value", context(F.col(text), F.col("x.start"), F.col("x.end")).alias("context"), "truncated")
