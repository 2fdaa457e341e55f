"""Format-preserving pseudonyms for personal data, by DataFrame functions alone.

A value is permuted by a keyed Feistel network within its own format, so equal values have equal pseudonyms
in all documents, different values stay different, and a pseudonym passes the checks that the value passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.spans import let as _let
from cubitgrid.llm.spans import rewrite

#: Fixed patterns of what is looked at; a match is replaced only if it is valid.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[/-]\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d|[.-]\d)|(?<![\w+])\+\d{8,15}(?!\d)"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d|\.\d)"
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "ipv4": IPV4, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Groups of digits that may hold cards among other numbers, however many: 13 digits at least, no group before a decimal point.
#: Its loops never give anything back: a loop that could would take a frame of the stack for each digit, and a stack that runs out ends the executor.
RUN = r"(?<![\d.])(?=\d(?:[ -]?\d){12}\d*+(?!\.\d))\d++(?:[ -]\d++(?!\.\d))*+"
ANY_RUN = "|".join(f"(?:{RUN if k == 'card' else p})" for k, p in KINDS.items())
#: A noncharacter that stands at the ends of accepted parts while a text is worked on. No pattern matches or looks for it,
#: so a text that holds it is worked on in the parts between.
MARK = "\ufdd0"

ROUNDS = 10
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Dates are permuted among the 270 * 271 days from 1900-01-01 on; others stay.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)


def _number(text: Column) -> Column:
    """The first 15 hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, of_a: Column, of_b: Column, tweak: Column, key: str) -> Column:
    """struct<a, b>: (a, b) permuted within 0..of_a-1 and 0..of_b-1 by rounds that add a keyed digest of one half
    to the other."""
    begin = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        half = F.when(r % 2 == 0, acc["b"]).otherwise(acc["a"])
        mix = _number(F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")), 256))
        return F.struct(F.when(r % 2 == 0, F.pmod(acc["a"] + mix, of_a)).otherwise(acc["a"]).cast("bigint").alias("a"), F.when(r % 2 == 1, F.pmod(acc["b"] + mix, of_b)).otherwise(acc["b"]).cast("bigint").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)


def _pad(n: Column, digits: Column) -> Column:
    return F.lpad(n.cast("string"), digits, "0")


def permute_digits(d: Column, kind: str, key: str) -> Column:
    """A string of 2 to 34 digits permuted among those of its length."""
    n = F.char_length(d)
    left = F.floor(n / 2).cast("int")
    right = n - left
    got = feistel(F.substring(d, F.lit(1), left), F.substring(d, left + 1, right), F.pow(F.lit(10), left).cast("bigint"), F.pow(F.lit(10), right).cast("bigint"), F.concat(F.lit(f"{kind}:"), n.cast("string")), key)
    return _let(got, lambda g: F.concat(_pad(g["a"], left), _pad(g["b"], right)))


def permute_letters(s: Column, kind: str, key: str) -> Column:
    """A string permuted among those with a digit, lower-case or upper-case letter wherever it has one."""
    n = F.char_length(s)
    left = F.floor(n / 2).cast("int")
    begin = F.struct(F.substring(s, F.lit(1), left).alias("a"), F.substring(s, left + 1, n - left).alias("b"))

    def shifted(text: Column, by: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            k = F.conv(F.substring(by, (i - 1) * 3 % 61 + 1, F.lit(3)), 16, 10).cast("int")
            alphabet = F.when(F.instr(F.lit(DIGITS), c) > 0, DIGITS).when(F.instr(F.lit(LOWER), c) > 0, LOWER).when(F.instr(F.lit(UPPER), c) > 0, UPPER)
            return F.when(alphabet.isNull(), c).otherwise(F.substring(alphabet, F.pmod(F.instr(alphabet, c) - 1 + k, F.char_length(alphabet)) + 1, F.lit(1)))

        return F.when(F.char_length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), one), ""))

    def turn(acc: Column, r: Column) -> Column:
        half = F.when(r % 2 == 0, acc["b"]).otherwise(acc["a"])
        mix = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), half), 256)
        return F.struct(F.when(r % 2 == 0, shifted(acc["a"], mix)).otherwise(acc["a"]).alias("a"), F.when(r % 2 == 1, shifted(acc["b"], mix)).otherwise(acc["b"]).alias("b"))

    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn), lambda g: F.concat(g["a"], g["b"]))


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by `digits`."""
    places = F.filter(F.sequence(F.lit(1), F.char_length(value)), lambda i: F.substring(value, i, F.lit(1)).rlike("[0-9]"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: _let(F.array_position(places, i), lambda at: F.when(at > 0, F.substring(digits, at.cast("int"), F.lit(1))).otherwise(F.substring(value, i, F.lit(1))))), "")


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum, where the last digit is doubled (a payload) or not (a whole number)."""
    back = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    values = F.transform(back, lambda c, i: _let(F.when(i % 2 == (0 if doubled_last else 1), c.cast("int") * 2).otherwise(c.cast("int")), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def _card(value: Column, key: str) -> Column:
    def payload(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), "card", key)
        return _let(body, lambda b: _refill(value, F.concat(b, F.pmod(-_luhn_sum(b, True), F.lit(10)).cast("string"))))

    return _let(_only_digits(value), lambda d: F.when((F.char_length(d).between(13, 19)) & (_luhn_sum(d, False) % 10 == 0), payload(d)).otherwise(value))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))

    def moved(p: Column) -> Column:
        got = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
        text = lambda g: F.concat_ws(".", *[x.cast("string") for x in (F.floor(g["a"] / 256), g["a"] % 256, F.floor(g["b"] / 256), g["b"] % 256)])
        return _let(got, text)

    return _let(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), moved(p)).otherwise(value))


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = F.substring(value, 1, 3).cast("int"), F.substring(value, 5, 2).cast("int"), F.substring(value, 8, 4).cast("int")
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    got = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def text(g: Column) -> Column:
        a = F.floor(g["a"] / 99) + 1
        return F.concat_ws("-", _pad(F.when(a >= 666, a + 1).otherwise(a), F.lit(3)), _pad(g["a"] % 99 + 1, F.lit(2)), _pad(g["b"] + 1, F.lit(4)))

    return F.when(good, _let(got, text)).otherwise(value)


def _date(value: Column, key: str) -> Column:
    """Year-month-day, day/month/year (month/day/year where only that is a date) or day.month.year."""
    parts = F.transform(F.split(value, "[-/.]"), lambda p: p.cast("int"))
    iso = value.rlike("^[0-9]{4}-")
    text = lambda y, m, d: F.concat_ws("-", _pad(y, F.lit(4)), _pad(m, F.lit(2)), _pad(d, F.lit(2)))

    def moved(p: Column) -> Column:
        as_day = F.try_to_timestamp(F.when(iso, text(p[0], p[1], p[2])).otherwise(text(p[2], p[1], p[0])), F.lit("yyyy-MM-dd")).cast("date")
        as_month = F.try_to_timestamp(F.when(~iso & value.contains("/"), text(p[2], p[0], p[1])), F.lit("yyyy-MM-dd")).cast("date")
        day = F.coalesce(as_day, as_month)
        n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
        got = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), _let(got, lambda g: (g["a"] * DAYS[1] + g["b"]).cast("int")))
        swap = as_day.isNull()
        written = _let(new, lambda t: F.when(iso, F.date_format(t, "yyyy-MM-dd")).when(value.contains("."), F.date_format(t, "dd.MM.yyyy")).when(swap, F.date_format(t, "MM/dd/yyyy")).otherwise(F.date_format(t, "dd/MM/yyyy")))
        return F.when(day.isNotNull() & n.between(0, DAYS[0] * DAYS[1] - 1), written).otherwise(value)

    return _let(parts, moved)


def _mod97(text: Column) -> Column:
    """Of letters and digits with A = 10 to Z = 35, read as one number."""
    def step(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    """The account part is permuted letter by letter and digit by digit; the check digits follow it."""
    plain = F.regexp_replace(value, " ", "")

    def moved(p: Column) -> Column:
        country, account = F.substring(p, 1, 2), F.substring(p, F.lit(5), F.char_length(p) - 4)
        new = permute_letters(account, "iban", key)
        full = _let(new, lambda a: F.concat(country, _pad(98 - _mod97(F.concat(a, country, F.lit("00"))), F.lit(2)), a))
        spaced = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: F.when(F.substring(value, i, F.lit(1)) == " ", " ").otherwise(F.substring(f, F.char_length(F.regexp_replace(F.substring(value, F.lit(1), i), " ", "")), F.lit(1)))), "")
        good = (F.char_length(p) >= 15) & (_mod97(F.concat(F.substring(p, F.lit(5), F.char_length(p) - 4), F.substring(p, 1, 4))) == 1)
        return F.when(good, _let(full, spaced)).otherwise(value)

    return _let(plain, moved)


def _phone(value: Column, key: str) -> Column:
    """Digits after a country code are permuted; 7 to 15 digits in all."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-]?\(|[ .-])", 0)

    def moved(rest: Column) -> Column:
        return _let(_only_digits(rest), lambda d: F.concat(code, _refill(rest, permute_digits(d, "phone", key))))

    total = F.char_length(_only_digits(value))
    return F.when(total.between(7, 15), _let(F.substring(value, F.char_length(code) + 1, F.char_length(value)), moved)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """All but the top-level domain is permuted."""
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    return F.concat(permute_letters(F.substring(value, F.lit(1), F.char_length(value) - F.char_length(top)), "email", key), top)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ANY; the match itself if it isn't valid."""
    whole = {k: f"^(?:{p})$" for k, p in KINDS.items()}
    made = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ip, "card": _card, "phone": _phone}
    cases = [(value.rlike(whole[k]), f(value, key)) for k, f in made.items()]
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), value)


def _mark_cards(run: Column, mark: Column) -> Column:
    """A run of digit groups with marks around its cards: from each group on the most groups that pass the check."""
    groups, between = F.split(run, "[ -]"), F.split(run, "[0-9]+")
    digits = lambda g, i, n: F.array_join(F.slice(g, i, n), "")

    def step(g: Column):
        def one(acc: Column, i: Column) -> Column:
            most = F.least(F.size(g) - i + 1, F.lit(19))
            good = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: _let(digits(g, i, n), lambda d: F.char_length(d).between(13, 19) & (_luhn_sum(d, False) % 10 == 0)))
            taken = _let(F.when(i >= acc["next"], F.get(good, F.lit(0))), lambda n: F.when(n.isNull(), acc).otherwise(F.struct((i + n).cast("int").alias("next"), F.concat(acc["first"], F.array(i)).alias("first"), F.concat(acc["last"], F.array((i + n - 1).cast("int"))).alias("last"))))
            return taken

        return one

    def marked(g: Column) -> Column:
        none = F.array().cast("array<int>")
        begin = F.struct(F.lit(1).alias("next"), none.alias("first"), none.alias("last"))
        found = F.aggregate(F.sequence(F.lit(1), F.size(g)), begin, step(g))
        at = lambda ends, i: F.when(F.array_contains(ends, i), mark).otherwise("")
        return _let(found, lambda f: F.when(F.size(f["first"]) == 0, run).otherwise(F.array_join(F.transform(g, lambda x, i: F.concat(F.get(between, i), at(f["first"], i + 1), x, at(f["last"], i + 1))), "")))

    return _let(groups, marked)


def _mark_iban(value: Column, mark: Column) -> Column:
    """A match of IBAN that fails its check with a mark after the most groups that pass it."""
    def marked(g: Column) -> Column:
        good = lambda n: _let(F.array_join(F.slice(g, F.lit(1), n), ""), lambda p: (F.char_length(p) >= 15) & (_mod97(F.concat(F.substring(p, F.lit(5), F.char_length(p) - 4), F.substring(p, 1, 4))) == 1))
        most = F.get(F.filter(F.sequence(F.size(g), F.lit(1), F.lit(-1)), good), F.lit(0))
        return _let(most, lambda n: F.when(n.isNull() | (n == F.size(g)), value).otherwise(F.concat(F.array_join(F.slice(g, F.lit(1), n), " "), mark, F.lit(" "), F.array_join(F.slice(g, n + 1, F.size(g)), " "))))

    return _let(F.split(value, " "), marked)


def _parted(text: Column, mark: Column) -> Column:
    """The text with marks where a card or IBAN ends within a longest match, or a card begins within one."""
    ibans = F.when(text.rlike(IBAN), rewrite(text, f"(?:{EMAIL})|(?:{IBAN})", lambda m: F.when(m.rlike(f"^(?:{IBAN})$"), _mark_iban(m, mark)).otherwise(m))).otherwise(text)
    return _let(ibans, lambda t: F.when(t.rlike(RUN), rewrite(t, ANY_RUN, lambda m: F.when(m.rlike(f"^(?:{RUN})$"), _mark_cards(m, mark)).otherwise(m))).otherwise(t))


def protect(text: Column, key: str) -> Column:
    whole = lambda t: rewrite(t, ANY, lambda m: pseudonym(m, key))
    parted = lambda t: F.replace(_let(_parted(t, F.lit(MARK)), whole), F.lit(MARK), F.lit(""))
    part = lambda t: F.when(t.rlike(f"(?:{IBAN})|(?:{RUN})"), parted(t)).otherwise(whole(t))
    return F.array_join(F.transform(F.split(text, MARK, -1), part), MARK)


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in `text`; every other column as it is.

    E-mail addresses, IPv4 addresses, IBANs and card numbers with right check digits, social security and phone
    numbers, and dates from 1900-01-01 on (270 * 271 days) are replaced; numbers that fail their check stay. Where
    groups of digits or letters follow or precede a card or IBAN, its own groups are found by their check.
    Null texts stay null and empty ones empty; rows, repeated ones too, are kept one for one. The key decides
    the pseudonyms, and whoever has it can undo them: keep it secret, and the same for all data that has to stay
    linked. It must not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    return docs.withColumn("text", protect(F.col("text"), key))
