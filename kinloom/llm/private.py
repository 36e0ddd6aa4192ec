"""Format-preserving pseudonyms: personal numbers, dates and identifiers are validated, then keyed-permuted in their format.

Everything is a Spark expression. Candidates come from one pattern; each is told apart and validated (Luhn for cards, mod 97
for IBANs, the calendar for dates, ranges for the rest), mapped into the product of two integer ranges and permuted by a
Feistel network on it: halves take turns to be shifted, modulo their range, by a keyed hash of the other half. A shift can be
undone, so each kind's map is a permutation of its valid values: equal values get equal pseudonyms in every document,
different ones different pseudonyms, and the format, separators and check digits stay valid. Mail addresses and secrets are
permuted character by character within lower-case letters, upper-case letters and digits; whether letters are capitals does not matter in addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
#: A text without any of these has no candidate: secrets have = or :, mail addresses @, access keys their first letters, the rest digits.
HINT = "[0-9@=:]|AKIA|ASIA"

SECRET = r"(?i:(?<![a-z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key)) ?[=:] ?[\"']?[A-Za-z0-9+/_-]{8,}"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
#: A domain has at most 127 labels. A group that repeats without a bound is matched by recursion, which a long text would exhaust.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: After two check digits, in groups of four; a following word does not belong to the IBAN. Countries without a known length: as far as it goes.
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:(?:{_KNOWN})|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
DATE = (
    r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
    r"|[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])(?!\.[0-9])"
)
#: Names of months in English, French, German and Spanish, and their abbreviations.
MONTHS = {
    lang: [names.split() for names in lists]
    for lang, lists in {
        "en": ("january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec", "jan feb mar apr may jun jul aug sept oct nov dec"),
        "fr": ("janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janv févr mars avr mai juin juil août sept oct nov déc"),
        "de": ("januar februar märz april mai juni juli august september oktober november dezember", "jan feb mär apr mai jun jul aug sep okt nov dez"),
        "es": ("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sep oct nov dic"),
    }.items()
}
MONTH = f"(?iu:{'|'.join(sorted({n for lists in MONTHS.values() for names in lists for n in names}, key=lambda n: (-len(n), n)))})"
NAMED_DATE = (
    rf"(?:(?<![\p{{L}}0-9./-])[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)?(?: de | of |[ -]){MONTH}\.?(?:, | del? |[ -])[0-9]{{4}}"
    rf"|(?<![\p{{L}}0-9]){MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})(?![0-9])"
)
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Codes of countries: one or two digits, else three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
INTERNATIONAL = r"(?<![0-9A-Za-z+])(?:\+[1-9]|00[1-9](?=[0-9]{0,2}[ .-]))(?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])"
#: North American without separators, and French.
UNSEPARATED = r"(?<![\p{L}0-9_.,/+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\p{L}0-9_/-])(?![.,][0-9])"
FRENCH = r"(?<![0-9.-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9-])(?!\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
#: Put around candidates, so that one pass finds them and what is between them; texts that have it are read twice.
MARK = "\x01"
CANDIDATE = "|".join((SECRET, ACCESS_KEY, MAIL, IBAN, DATE, NAMED_DATE, ADDRESS, PHONE, INTERNATIONAL, UNSEPARATED, FRENCH, SOCIAL, CARD))


def keyed(key: str, kind: str, turn: Column, half: Column) -> Column:
    """60 bits of a keyed hash of the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column | int, size_b: Column | int) -> Column:
    """A permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as a struct."""
    size_a, size_b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (size_a, size_b))

    def turn(s: Column, r: Column) -> Column:
        odd = F.struct(F.pmod(s["a"] + keyed(key, kind, r, s["b"]), size_a).alias("a"), s["b"].alias("b"))
        even = F.struct(s["a"].alias("a"), F.pmod(s["b"] + keyed(key, kind, r, s["a"]), size_b).alias("b"))
        return F.when(r % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(key: str, kind: str, d: Column) -> Column:
    """A string of two to thirty digits, permuted among those of its length."""
    left = F.floor(F.length(d) / 2).cast("int")
    right = F.length(d) - left
    power = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
    whole = feistel(key, kind, F.substring(d, F.lit(1), left), F.substring(d, left + 1, right), power(left), power(right))
    return joined(whole, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), right, F.lit("0"))))


def joined(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def filled(template: Column, d: Column) -> Column:
    """The template with its digits replaced by those of d, in order."""

    def step(s: Column, c: Column) -> Column:
        return F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(d, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def luhn_sum(d: Column, shift: int) -> Column:
    """Luhn's sum; shift 1: as if a check digit 0 followed."""

    def step(s: Column, c: Column) -> Column:
        twice = c.cast("int") * 2
        value = F.when(s["k"] % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))
        return F.struct((s["sum"] + value).alias("sum"), (s["k"] + 1).alias("k"))

    return F.aggregate(F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("sum"), F.lit(shift).alias("k")), step, lambda s: s["sum"])


def with_check(d: Column) -> Column:
    return F.concat(d, F.pmod(F.lit(10) - luhn_sum(d, 1) % 10, F.lit(10)).cast("string"))


def card(key: str, m: Column) -> Column:
    d = digits(m)
    changed = joined(permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1)), with_check)
    return F.when(luhn_sum(d, 0) % 10 == 0, filled(m, changed))


def mod97(text: Column) -> Column:
    """The remainder of an IBAN's number, letters counted from 10."""

    def step(s: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n > 9, (s * 100 + n) % 97).otherwise((s * 10 + n) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(key: str, m: Column) -> Column:
    """The digits of the account are permuted and the two check digits follow; letters and spaces stay."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    d = digits(account)
    new = filled(account, permuted_digits(key, "iban", d))
    whole = joined(new, lambda a: F.concat(F.lpad((F.lit(98) - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), digits(a)))
    valid = (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & (F.length(d) >= 6)
    return F.when(valid, filled(m, whole))


def moved_date(key: str, year: Column, month: Column, day: Column, shape) -> Column:
    """A day of 1900-2099 becomes another day of its century: 36,524 = 92 x 397 and 36,525 = 75 x 487 days."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = year.between(1900, 2099) & month.between(1, 12) & (day >= 1) & (day <= last)
    old = year < 2000
    start = F.when(old, F.lit("1900-01-01")).otherwise(F.lit("2000-01-01")).cast("date")
    size_b = F.when(old, F.lit(397)).otherwise(F.lit(487)).cast("long")
    size_a = F.when(old, F.lit(92)).otherwise(F.lit(75)).cast("long")
    number = F.datediff(F.make_date(year, month, day), start).cast("long")
    moved = feistel(key, "date", F.floor(number / size_b), F.pmod(number, size_b), size_a, size_b)
    new = joined(moved, lambda s: F.date_add(start, (s["a"] * size_b + s["b"]).cast("int")))
    return F.when(valid, joined(new, shape))


def date(key: str, m: Column) -> Column:
    """Slashes after a day or month: month first unless only the second number can be a month's day. Years of two digits count as 2000 to 2099."""
    p = F.split(m, "[-/.]")
    a, b, c = (F.element_at(p, i).cast("int") for i in (1, 2, 3))
    year_first, short = m.rlike("^[0-9]{4}"), F.length(F.element_at(p, 3)) == 2
    day_first = ~year_first & (~m.contains("/") | (a > 12))
    year = F.when(year_first, a).when(short, c + 2000).otherwise(c)
    month, day = F.when(year_first | day_first, b).otherwise(a), F.when(year_first, c).when(day_first, a).otherwise(b)
    mark = F.regexp_extract(m, "[-/.]", 0)

    def shape(x: Column) -> Column:
        y, mm, dd = F.date_format(x, "yyyy"), F.date_format(x, "MM"), F.date_format(x, "dd")
        end = F.when(short, F.substring(y, 3, 2)).otherwise(y)
        return F.when(year_first, F.concat_ws("-", y, mm, dd)).when(day_first, F.concat_ws("-", dd, mm, end)).otherwise(F.concat_ws("-", mm, dd, end))

    return F.replace(moved_date(key, year, month, day, shape), F.lit("-"), mark)


def month_names(name: Column, m: Column) -> Column:
    """The list of months that the name is from; a dot after the day speaks for German, a `de` for Spanish."""

    def first(*langs: str) -> Column:
        lists = [F.array(*map(F.lit, names)) for lang in langs for names in MONTHS[lang]]
        return F.coalesce(*[F.when(F.array_contains(x, name), x) for x in lists])

    return F.when(m.rlike(r"^[0-9]+\."), first("de", "en", "fr", "es")).when(m.contains(" de "), first("es", "fr", "en", "de")).otherwise(first("en", "fr", "de", "es"))


def named_date(key: str, m: Column) -> Column:
    """Day, name and year are replaced where they stand; ordinals follow the day, names keep their language and case."""
    found = F.regexp_extract(m, MONTH, 0)
    names = month_names(F.lower(found), m)
    day, year = F.regexp_extract(m, "(?<![0-9])([0-9]{1,2})(?![0-9])", 1).cast("int"), F.regexp_extract(m, "[0-9]{4}", 0).cast("int")
    ordinal = F.regexp_extract(m, "(?<=[0-9])(?:st|nd|rd|th|er)", 0)

    def shape(x: Column) -> Column:
        d = F.dayofmonth(x)
        low = F.element_at(names, F.month(x))
        name = F.when(found == F.lower(found), low).when(found == F.upper(found), F.upper(low)).otherwise(F.initcap(low))
        nth = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
        end = F.when(ordinal == "", "").when(ordinal == "er", F.when(d == 1, "er").otherwise("")).otherwise(nth)
        dated = F.regexp_replace(m, F.lit("[0-9]{4}"), F.date_format(x, "yyyy"))
        dated = F.regexp_replace(dated, F.lit("(?<![0-9])[0-9]{1,2}(?![0-9])(?:st|nd|rd|th|er)?"), F.concat(d.cast("string"), end))
        return F.regexp_replace(dated, F.lit(MONTH), name)

    return moved_date(key, year, F.array_position(names, F.lower(found)).cast("int"), day, shape)


def address(key: str, m: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    at = lambda i: F.element_at(p, i)
    moved = feistel(key, "address", at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536)
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return F.when(F.array_max(p) <= 255, joined(moved, lambda s: F.concat_ws(".", part(s["a"]), part(s["b"]))))


def phone(key: str, m: Column) -> Column:
    """Ten digits, in three sets that each keep to themselves, so no two numbers meet: area and exchange start with 2 to 9; only the area does; the area does not."""
    d = F.substring(digits(m), -10, 10)
    area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
    high, usual = area >= 200, rest >= 2_000_000
    kind_least, areas = F.when(high, 200).otherwise(0).cast("long"), F.when(high, 800).otherwise(200).cast("long")
    rest_least = F.when(high & usual, 2_000_000).otherwise(0).cast("long")
    rests = F.when(~high, 10_000_000).when(usual, 8_000_000).otherwise(2_000_000).cast("long")
    moved = feistel(key, "phone", area - kind_least, rest - rest_least, areas, rests)
    new = joined(moved, lambda s: F.concat(F.lpad((s["a"] + kind_least).cast("string"), 3, "0"), F.lpad((s["b"] + rest_least).cast("string"), 7, "0")))
    return filled(m, F.when(F.length(digits(m)) > 10, F.concat(F.lit("1"), new)).otherwise(new))


def french(key: str, d: Column) -> Column:
    moved = feistel(key, "french", F.substring(d, 2, 1).cast("long") - 1, F.substring(d, 3, 8).cast("long"), 9, 100_000_000)
    return joined(moved, lambda s: F.concat(F.lit("0"), (s["a"] + 1).cast("string"), F.lpad(s["b"].cast("string"), 8, "0")))


def other_phone(key: str, m: Column) -> Column:
    """International numbers keep their country's code, French ones their 0 and a digit that is none after it; +1 is moved as without separators."""
    d = F.regexp_replace(digits(m), "^00", "")
    code = F.regexp_extract(d, f"^(?:{COUNTRY})", 0)
    rest = F.substring(d, F.length(code) + 1, F.length(d))
    prefix = F.regexp_extract(digits(m), "^00", 0)
    return (
        F.when(m.rlike(f"^(?:{FRENCH})$"), filled(m, french(key, digits(m))))
        .when(m.rlike(f"^(?:{UNSEPARATED})$"), phone(key, m))
        .when((code == "1") & (F.length(d) == 11), filled(m, F.concat(prefix, digits(phone(key, F.concat(F.lit("+"), d))))))
        .otherwise(filled(m, F.concat(prefix, code, permuted_digits(key, "international", rest))))
    )


def social(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    moved = feistel(key, "social", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999)
    number = lambda s: F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
    return F.when(valid, joined(moved, lambda s: F.concat_ws("-", F.lpad(number(s).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9_999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(s["b"], F.lit(9_999)) + 1).cast("string"), 4, "0"))))


def shifted(chars: Column, stream: Column) -> Column:
    """Each letter or digit moves within its class by a byte of the stream (64 hexadecimal digits)."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        return (
            F.when(c.rlike("[0-9]"), F.char((code - 48 + by) % 10 + 48))
            .when(c.rlike("[a-z]"), F.char((code - 97 + by) % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char((code - 65 + by) % 26 + 65))
            .otherwise(c)
        )

    return F.transform(chars, move)


def permuted_text(key: str, kind: str, value: Column) -> Column:
    """A string permuted among those with the same kinds of characters in the same places: digits, lower-case and upper-case letters.
    The classes follow from the format alone, never from which letters a value happens to have, so no two values meet."""
    chars = F.split(value, "")
    left = F.floor(F.size(chars) / 2).cast("int")

    def stream(r: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(other, "")).cast("binary"), 256)

    def turn(s: Column, r: Column) -> Column:
        odd = F.struct(joined(stream(r, s["b"]), lambda x: shifted(s["a"], x)).alias("a"), s["b"].alias("b"))
        even = F.struct(s["a"].alias("a"), joined(stream(r, s["a"]), lambda x: shifted(s["b"], x)).alias("b"))
        return F.when(r % 2 == 1, odd).otherwise(even)

    start = F.struct(F.slice(chars, F.lit(1), left).alias("a"), F.slice(chars, left + 1, F.size(chars) - left).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))


def caseless(key: str, kind: str, value: Column) -> Column:
    """Permuted as if in lower case; capitals stay where they were, so spellings of one value that differ in case have pseudonyms that do as well."""
    old = F.split(value, "")
    new = F.split(permuted_text(key, kind, F.lower(value)), "")
    return F.array_join(F.zip_with(old, new, lambda o, n: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")


def mail(key: str, m: Column) -> Column:
    """The local part and the domain move each by itself, so addresses of one domain still share one; the last label of the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    last = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(caseless(key, "mail", local), F.lit("@"), caseless(key, "domain", name), F.lit("."), last)


def secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]{8,}$", 0)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), permuted_text(key, "secret", value))


def access_key(key: str, m: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), permuted_text(key, "access_key", F.substring(m, 5, 16)))


KINDS = (
    ("secret", SECRET, secret), ("access_key", ACCESS_KEY, access_key), ("mail", MAIL, mail), ("iban", IBAN, iban), ("date", DATE, date), ("date", NAMED_DATE, named_date),
    ("address", ADDRESS, address), ("phone", PHONE, phone), ("phone", f"{INTERNATIONAL}|{UNSEPARATED}|{FRENCH}", other_phone), ("social", SOCIAL, social), ("card", CARD, card),
)


def pseudonym(key: str, m: Column) -> Column:
    """(kind, out) for a candidate; kind null and out the candidate itself if no kind holds it for valid."""
    out, kind = None, None
    for name, pattern, f in KINDS:
        whole = m.rlike(f"^(?:{pattern})$")
        out = F.when(whole, f(key, m)) if out is None else out.when(whole, f(key, m))
        kind = F.when(whole, F.lit(name)) if kind is None else kind.when(whole, F.lit(name))
    return joined(F.struct(kind.alias("kind"), out.alias("new")), lambda s: F.struct(F.when(s["new"].isNotNull(), s["kind"]).alias("kind"), F.coalesce(s["new"], m).alias("out")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(row, text, found): row is the whole row of docs as a struct, text the new text, found the (kind, pseudonym) in order.

    No shuffle and no Python. A null text stays null, an empty one empty, both without findings; rows that repeat get the
    same text; an empty table gives no rows; other columns are untouched inside row, whatever their names.
    """
    text = F.col("text")
    base = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    marked = F.split(F.regexp_replace(text, CANDIDATE, f"{MARK}$0{MARK}"), MARK, -1)
    by_turns = F.flatten(F.zip_with(F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    base = base.withColumn("pieces", F.when(text.rlike(HINT), F.when(text.contains(MARK), by_turns).otherwise(marked)))
    some = F.exists(F.transform("pieces", lambda m, i: (i % 2 == 1) & (m != "")), lambda x: x)
    base = base.withColumn("some", F.coalesce(some, F.lit(False)))
    base = base.withColumn("parts", F.when(F.col("some"), F.transform(F.filter("pieces", lambda m, i: i % 2 == 1), lambda m: pseudonym(key, m))))
    gaps, some = F.filter("pieces", lambda m, i: i % 2 == 0), F.col("some")
    new = F.array_join(F.zip_with(gaps, F.col("parts"), lambda g, p: F.concat(g, F.coalesce(p["out"], F.lit("")))), "")
    found = F.transform(F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["out"].alias("pseudonym")))
    return base.select("row", F.when(some, new).otherwise(text).alias("text"), F.coalesce(F.when(some, found), F.array().cast("array<struct<kind:string,pseudonym:string>>")).alias("found"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; this one is for the test tables only."""
    out = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), key="kinloom-test-key")
    return out.select("row.doc_id", "text", F.size("found").cast("long").alias("n_found"), F.col("found.kind").alias("kinds"), F.col("found.pseudonym").alias("pseudonyms"))
