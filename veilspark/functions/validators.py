"""Validators of candidate values, as Column expressions of (value, whole text, start, end); offsets count code points from 0."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.constants import ints

Validator = Callable[[Column, Column, Column, Column], Column]

# Weights, check letters and tables of the identity numbers' standards.
CN_ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CN_ID_CHECK = "10X98765432"
USCC_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
ES_CHECK = "TRWAGMYFPDXBNJZSQVHLCKE"
FI_CHECK = "0123456789ABCDEFHJKLMNPRSTUVWXY"
VERHOEFF_D = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    """The digit at place i; null where there is none."""
    return F.substring(d, i + 1, 1).try_cast("int")


def _letters(v: Column, n: int) -> Column:
    return F.slice(F.split(v, ""), 1, n)


def weighted(d: Column, weights: tuple[int, ...], value: Callable[[Column], Column] = lambda c: c.try_cast("int")) -> Column:
    """The sum of the first letters' values, weighted; null where one of them has none."""
    return F.aggregate(F.zip_with(_letters(d, len(weights)), ints(weights), lambda c, w: value(c) * w), F.lit(0), lambda a, x: a + x)


def _place(letters: str, c: Column) -> Column:
    """Where c stands in `letters`, from 0; -1 if nowhere."""
    return F.instr(F.lit(letters), c) - 1


def _sized(d: Column, n: int, check: Column) -> Column:
    """`check` where d has n digits, else false."""
    return F.when(F.length(d) == n, F.coalesce(check, F.lit(False))).otherwise(False)


def _date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull()


@dataclass(frozen=True)
class Keywords:
    """True where one of some words stands within `reach` characters of the value, or in it; `pattern` finds them in lower case."""

    pattern: str
    reach: int

    def __call__(self, v: Column, text: Column, start: Column, end: Column) -> Column:
        return F.lower(self.around(text, start, end, F.lit(self.reach))).rlike(self.pattern)

    @staticmethod
    def around(text: Column, start: Column, end: Column, reach: Column) -> Column:
        low = F.greatest(start - reach, F.lit(0))
        return F.substring(text, low + 1, end + reach - low)


def keywords(*words: str, reach: int = 32) -> Keywords:
    return Keywords("|".join(rf"\Q{w.lower()}\E" for w in words), reach)


def always(v: Column, *_: Column) -> Column:
    return F.trim(v) != ""


def luhn(v: Column, *_: Column) -> Column:
    return F.length(digits(v)).between(13, 19) & F.call_function("luhn_check", digits(v))


def canadian_sin(v: Column, *_: Column) -> Column:
    return (F.length(digits(v)) == 9) & ~digits(v).rlike("^0+$") & F.call_function("luhn_check", digits(v))


def international_phone(v: Column, *_: Column) -> Column:
    return F.length(digits(v)).between(8, 15) & ~digits(v).rlike("^0+$")


def us_ssn(v: Column, *_: Column) -> Column:
    return digits(v).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def aba_routing(v: Column, text: Column, start: Column, end: Column) -> Column:
    d = digits(v)
    return _sized(d, 9, (weighted(d, (3, 7, 1) * 3) % 10 == 0) & ~d.rlike("^0+$")) & keywords("routing", "aba", "transit number", "联行号", "路由号码")(v, text, start, end)


def cn_resident_id(v: Column, *_: Column) -> Column:
    u = F.upper(v)
    expected = F.get(F.split(F.lit(CN_ID_CHECK), ""), weighted(u, CN_ID_WEIGHTS) % 11)
    return F.when(u.rlike("^[0-9]{17}[0-9X]$"), _date(F.substring(u, 7, 8)) & (expected == F.substring(u, 18, 1))).otherwise(False)


def cn_resident_id_15(v: Column, *_: Column) -> Column:
    d = digits(v)
    return d.rlike("^[1-9][0-9]{14}$") & _date(F.concat(F.lit("19"), F.substring(d, 7, 6)))


def uscc(v: Column, *_: Column) -> Column:
    u = F.upper(v)
    total = weighted(u, USCC_WEIGHTS, lambda c: _place(USCC_CHARS, c))
    at = F.pmod(31 - total % 31, F.lit(31))
    return F.when(u.rlike(f"^[{USCC_CHARS}]{{18}}$"), F.get(F.split(F.lit(USCC_CHARS), ""), at) == F.substring(u, 18, 1)).otherwise(False)


def iban(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, r"\s", ""))
    turned = F.concat(F.substring(u, 5, 40), F.substring(u, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.when(u.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def uk_nino(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, "[ -]", ""))
    return u.rlike("^(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]?$")


def uk_nhs(v: Column, *_: Column) -> Column:
    d = digits(v)
    check = 11 - weighted(d, (10, 9, 8, 7, 6, 5, 4, 3, 2)) % 11
    return _sized(d, 10, (check != 10) & (check % 11 == _digit(d, 9)))


def german_tax_id(v: Column, *_: Column) -> Column:
    d = digits(v)
    product = F.lit(10)
    for i in range(10):
        s = (_digit(d, i) + product) % 10
        product = (F.when(s == 0, 10).otherwise(s) * 2) % 11
    return _sized(d, 11, (_digit(d, 0) != 0) & ((11 - product) % 10 == _digit(d, 10)))


def french_nir(v: Column, *_: Column) -> Column:
    d = digits(v)
    return _sized(d, 15, 97 - F.substring(d, 1, 13).try_cast("long") % 97 == F.substring(d, 14, 2).try_cast("long"))


def spanish_dni_nie(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, "[ -]", ""))
    number = F.translate(F.substring(u, 1, 8), "XYZ", "012").try_cast("int")
    return F.coalesce((F.length(u) == 9) & (F.get(F.split(F.lit(ES_CHECK), ""), number % 23) == F.substring(u, 9, 1)), F.lit(False))


# What a character counts at an odd place of an Italian fiscal code, from 0 to 9 and from A to Z.
IT_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def italian_fiscal_code(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, r"\s", ""))
    at = lambda c: F.when(F.ascii(c) <= 57, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    even = lambda c: F.when(F.ascii(c) <= 57, F.ascii(c) - 48).otherwise(F.ascii(c) - 65)
    total = F.aggregate(F.transform(_letters(u, 15), lambda c, i: F.when(i % 2 == 0, F.get(ints(IT_ODD), at(c))).otherwise(even(c))), F.lit(0), lambda a, x: a + x)
    return F.when(u.rlike("^[A-Z]{6}[0-9]{2}[ABCDEHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]$"), total % 26 == F.ascii(F.substring(u, 16, 1)) - 65).otherwise(False)


def dutch_bsn(v: Column, *_: Column) -> Column:
    d = digits(v)
    return _sized(d, 9, (weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, -1)) % 11 == 0) & ~d.rlike("^0+$"))


def polish_pesel(v: Column, *_: Column) -> Column:
    d = digits(v)
    return _sized(d, 11, (10 - weighted(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == _digit(d, 10))


def _day_month(d: Column) -> Column:
    """Whether four digits are a day and a month of a leap year."""
    return _date(F.concat(F.lit("2000"), F.substring(d, 3, 2), F.substring(d, 1, 2)))


def swedish_person_number(v: Column, *_: Column) -> Column:
    d = F.right(digits(v), F.lit(10))
    return F.length(digits(v)).isin(10, 12) & _date(F.concat(F.lit("20"), F.substring(d, 1, 6))) & F.call_function("luhn_check", d)


def _mod_11(d: Column, weights: tuple[int, ...]) -> Column:
    """The check digit of weighted digits; null where it would be 10."""
    check = (11 - weighted(d, weights) % 11) % 11
    return F.when(check < 10, check)


def norwegian_birth_number(v: Column, *_: Column) -> Column:
    d = digits(v)
    first, second = _mod_11(d, (3, 7, 6, 1, 8, 9, 4, 5, 2)), _mod_11(d, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
    return _sized(d, 11, _day_month(d) & (first == _digit(d, 9)) & (second == _digit(d, 10)))


def new_zealand_ird(v: Column, *_: Column) -> Column:
    d = F.when(F.length(digits(v)) == 8, F.concat(F.lit("0"), digits(v))).otherwise(digits(v))
    check = F.coalesce(_mod_11(d, (3, 2, 7, 6, 5, 4, 3, 2)), _mod_11(d, (7, 4, 3, 2, 5, 2, 7, 6)))
    return _sized(d, 9, check == _digit(d, 8))


def finnish_code(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, r"\s", ""))
    number = F.concat(F.substring(u, 1, 6), F.substring(u, 8, 3)).try_cast("int")
    return F.coalesce(u.rlike("^[0-9]{6}[+\\-ABCDEFYXWVU][0-9]{3}[0-9A-Z]$") & _day_month(u) & (F.get(F.split(F.lit(FI_CHECK), ""), number % 31) == F.substring(u, 11, 1)), F.lit(False))


def australian_tfn(v: Column, *_: Column) -> Column:
    d = F.when(F.length(digits(v)) == 8, F.concat(F.lit("0"), digits(v))).otherwise(digits(v))
    return _sized(d, 9, (weighted(d, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0))


def japan_my_number(v: Column, *_: Column) -> Column:
    d = digits(v)
    rest = weighted(d, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return _sized(d, 12, F.when(rest <= 1, 0).otherwise(11 - rest) == _digit(d, 11))


def korean_resident(v: Column, *_: Column) -> Column:
    d = digits(v)
    return _sized(d, 13, (11 - weighted(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == _digit(d, 12))


def singapore_nric(v: Column, *_: Column) -> Column:
    u = F.upper(v)
    first = F.substring(u, 1, 1)
    total = weighted(F.substring(u, 2, 7), (2, 7, 6, 5, 4, 3, 2)) + F.when(first.isin("T", "G"), 4).when(first == "M", 3).otherwise(0)
    letters = F.when(first.isin("S", "T"), "JZIHGFEDCBA").when(first.isin("F", "G"), "XWUTRQPNMLK").otherwise("KLJNPQRTUWX")
    at = F.when(first == "M", 10 - total % 11).otherwise(total % 11)
    return F.coalesce(u.rlike("^[STFGM][0-9]{7}[A-Z]$") & (F.get(F.split(letters, ""), at) == F.substring(u, 9, 1)), F.lit(False))


def verhoeff(d: Column) -> Column:
    dt, pt = (ints(x for row in t for x in row) for t in (VERHOEFF_D, VERHOEFF_P))  # ten a row
    turned = F.transform(F.reverse(_letters(d, 12)), lambda c, i: F.get(pt, i % 8 * 10 + c.try_cast("int")))
    return F.aggregate(turned, F.lit(0), lambda a, x: F.get(dt, a * 10 + x)) == 0


def india_aadhaar(v: Column, text: Column, start: Column, end: Column) -> Column:
    d = digits(v)
    return _sized(d, 12, (_digit(d, 0) >= 2) & verhoeff(d)) & keywords("aadhaar", "uidai", "आधार", "印度身份号码")(v, text, start, end)


def taiwan_id(v: Column, *_: Column) -> Column:
    u = F.upper(v)
    # The letters' codes from 10 upwards are A to H, J to N, P to V, X, Y, W, Z, I, O.
    code = _place("ABCDEFGHJKLMNPQRSTUVXYWZIO", F.substring(u, 1, 1)) + 10
    total = F.floor(code / 10) + code % 10 * 9 + weighted(F.substring(u, 2, 9), (8, 7, 6, 5, 4, 3, 2, 1, 1))
    return F.coalesce(u.rlike("^[A-Z][12][0-9]{8}$") & (total % 10 == 0), F.lit(False))


def hong_kong_id(v: Column, *_: Column) -> Column:
    u = F.upper(F.regexp_replace(v, r"[\s()]", ""))
    whole = F.lpad(u, 9, " ")
    letter = lambda i: F.when(F.substring(whole, i, 1) == " ", 36).otherwise(F.ascii(F.substring(whole, i, 1)) - 55)
    total = letter(1) * 9 + letter(2) * 8 + weighted(F.substring(whole, 3, 6), (7, 6, 5, 4, 3, 2))
    last = F.when(F.substring(whole, 9, 1) == "A", 10).otherwise(F.substring(whole, 9, 1).try_cast("int"))
    return F.coalesce(u.rlike("^[A-Z]{1,2}[0-9]{6}[0-9A]$") & ((total + last) % 11 == 0), F.lit(False))


def ipv4(v: Column, *_: Column) -> Column:
    return v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def ipv6(v: Column, *_: Column) -> Column:
    short = F.size(F.split(v, "::", -1)) - 1
    groups = F.filter(F.split(v, ":", -1), lambda g: g != "")
    ends = v.rlike("^(?!:[^:])") & v.rlike("(?<![^:]:)$")
    return v.contains(":") & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & ends & ~v.contains(":::") & F.when(short == 0, F.size(groups) == 8).otherwise((short == 1) & (F.size(groups) <= 7))


def ipv4_cidr(v: Column, *_: Column) -> Column:
    return ipv4(F.get(F.split(v, "/"), F.lit(0))) & F.coalesce(F.get(F.split(v, "/"), F.lit(1)).try_cast("int").between(0, 32), F.lit(False))


def ipv6_cidr(v: Column, *_: Column) -> Column:
    return ipv6(F.get(F.split(v, "/"), F.lit(0))) & F.coalesce(F.get(F.split(v, "/"), F.lit(1)).try_cast("int").between(0, 128), F.lit(False))


def imei(v: Column, *_: Column) -> Column:
    return (F.length(digits(v)) == 15) & ~digits(v).rlike("^0+$") & F.call_function("luhn_check", digits(v))


def iccid(v: Column, *_: Column) -> Column:
    return digits(v).rlike("^89[0-9]{17,18}$") & F.call_function("luhn_check", digits(v))


def vin(v: Column, text: Column, start: Column, end: Column) -> Column:
    return (F.length(v) == 17) & keywords("vin", "vehicle identification", "chassis", "车架号", "车辆识别代号", "차대번호", "車台番号")(v, text, start, end)


def coordinates(v: Column, *_: Column) -> Column:
    parts = F.split(F.regexp_replace(v, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[,，\s]+", -1)
    a, b = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    inside = (F.abs(a) <= 90) & (F.abs(b) <= 180) | (F.abs(a) <= 180) & (F.abs(b) <= 90)
    return F.coalesce((F.size(parts) == 2) & inside, F.lit(False))
