"""Pseudonyms against a version in plain Python: whole texts of a table, planted values of every kind, and the pipeline's stage."""

import datetime as dt
import hashlib
import os
import random

import pytest
import regex

from kinloom.llm import private as p

DATA = "/root/testdata/sf0.001"
JAVA = lambda pattern: pattern.replace("(?iu:", "(?i:")  # noqa: E731 - letters are Unicode here without a flag


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def feistel(key, kind, a, b, size_a, size_b):
    for r in range(1, p.ROUNDS + 1):
        if r % 2:
            a = (a + int(sha(key, kind, r, b)[:15], 16)) % size_a
        else:
            b = (b + int(sha(key, kind, r, a)[:15], 16)) % size_b
    return a, b


def digits(m):
    return "".join(c for c in m if c in "0123456789")


def filled(m, d):
    rest = iter(d)
    return "".join(next(rest, "") if c in "0123456789" else c for c in m)


def moved_digits(key, kind, d):
    n = len(d) // 2
    a, b = feistel(key, kind, int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n))
    return f"{a:0{n}d}{b:0{len(d) - n}d}"


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def card(key, m):
    d = digits(m)
    if luhn(d):
        return None
    new = moved_digits(key, "card", d[:-1])
    return filled(m, next(new + c for c in "0123456789" if luhn(new + c) == 0))


def number97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(key, m):
    plain = m.replace(" ", "")
    d = digits(plain[4:])
    if number97(plain[4:] + plain[:4]) != 1 or len(d) < 6:
        return None
    account = filled(plain[4:], moved_digits(key, "iban", d))
    return filled(m, f"{98 - number97(account + plain[:2] + '00'):02d}" + digits(account))


def moved_day(key, y, m, d):
    try:
        day = dt.date(y, m, d)
    except ValueError:
        return None
    if not 1900 <= y <= 2099:
        return None
    start, a, b = (dt.date(1900, 1, 1), 92, 397) if y < 2000 else (dt.date(2000, 1, 1), 75, 487)
    n = (day - start).days
    x, z = feistel(key, "date", n // b, n % b, a, b)
    return start + dt.timedelta(days=x * b + z)


def date(key, m):
    parts, mark = regex.split("[-/.]", m), regex.search("[-/.]", m)[0]
    a, b, c = map(int, parts)
    if len(parts[0]) == 4:
        new = moved_day(key, a, b, c)
        return new and mark.join((f"{new.year}", f"{new.month:02d}", f"{new.day:02d}"))
    short = len(parts[2]) == 2
    day_first = mark != "/" or a > 12
    new = moved_day(key, c + 2000 if short else c, *((b, a) if day_first else (a, b)))
    if new is None:
        return None
    two = (f"{new.day:02d}", f"{new.month:02d}")
    return mark.join((*(two if day_first else two[::-1]), f"{new.year % 100:02d}" if short else f"{new.year}"))


def named_date(key, m):
    found = regex.search(JAVA(p.MONTH), m)[0]
    if regex.match("[0-9]+\\.", m):
        langs = ("de", "en", "fr", "es")
    else:
        langs = ("es", "fr", "en", "de") if " de " in m else ("en", "fr", "de", "es")
    names = next(x for lang in langs for x in p.MONTHS[lang] if found.lower() in x)
    day, year = int(regex.search("(?<![0-9])[0-9]{1,2}(?![0-9])", m)[0]), int(regex.search("[0-9]{4}", m)[0])
    new = moved_day(key, year, names.index(found.lower()) + 1, day)
    if new is None:
        return None
    name = names[new.month - 1]
    name = name if found == found.lower() else name.upper() if found == found.upper() else name[:1].upper() + name[1:]
    ordinal = regex.search("(?<=[0-9])(?:st|nd|rd|th|er)", m)
    end = ""
    if ordinal:
        usual = {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th") if new.day // 10 != 1 else "th"
        end = ("er" if new.day == 1 else "") if ordinal[0] == "er" else usual
    out = regex.sub("[0-9]{4}", f"{new.year}", m)
    out = regex.sub("(?<![0-9])[0-9]{1,2}(?![0-9])(?:st|nd|rd|th|er)?", f"{new.day}{end}", out)
    return regex.sub(JAVA(p.MONTH), name, out)


def address(key, m):
    a, b, c, d = map(int, m.split("."))
    if max(a, b, c, d) > 255:
        return None
    x, y = feistel(key, "address", a * 256 + b, c * 256 + d, 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def phone(key, m):
    d = digits(m)[-10:]
    area, rest = int(d[:3]), int(d[3:])
    low_a, n_a = (200, 800) if area >= 200 else (0, 200)
    low_r, n_r = (0, 10**7) if area < 200 else (2 * 10**6, 8 * 10**6) if rest >= 2 * 10**6 else (0, 2 * 10**6)
    x, y = feistel(key, "phone", area - low_a, rest - low_r, n_a, n_r)
    return filled(m, ("1" if len(digits(m)) > 10 else "") + f"{x + low_a:03d}{y + low_r:07d}")


def other_phone(key, m):
    d = digits(m)
    if regex.fullmatch(p.FRENCH, m):
        x, y = feistel(key, "french", int(d[1]) - 1, int(d[2:]), 9, 10**8)
        return filled(m, f"0{x + 1}{y:08d}")
    if regex.fullmatch(p.UNSEPARATED, m):
        return phone(key, m)
    prefix = "00" if d.startswith("00") else ""
    d = d[len(prefix) :]
    code = regex.match(f"(?:{p.COUNTRY})", d)
    code = code[0] if code else ""
    if code == "1" and len(d) == 11:
        return filled(m, prefix + digits(phone(key, "+" + d)))
    return filled(m, prefix + code + moved_digits(key, "international", d[len(code) :]))


def social(key, m):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = [n for n in range(1, 900) if n != 666]
    x, y = feistel(key, "social", areas.index(area), (group - 1) * 9_999 + serial - 1, len(areas), 99 * 9_999)
    return f"{areas[x]:03d}-{y // 9_999 + 1:02d}-{y % 9_999 + 1:04d}"


def moved_text(key, kind, value):
    n = len(value) // 2
    a, b = value[:n], value[n:]

    def shifted(s, stream):
        out = []
        for i, c in enumerate(s):
            by = int(stream[2 * (i % 32) :][:2], 16)
            low, size = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
            out.append(chr((ord(c) - low + by) % size + low))
        return "".join(out)

    for r in range(1, p.ROUNDS + 1):
        if r % 2:
            a = shifted(a, sha(key, kind, r, b))
        else:
            b = shifted(b, sha(key, kind, r, a))
    return a + b


def mail(key, m):
    local, domain = m.split("@")
    name, last = domain.rsplit(".", 1)
    cased = lambda kind, s: "".join(n.upper() if "A" <= o <= "Z" else n for o, n in zip(s, moved_text(key, kind, s.lower()), strict=True))
    return f"{cased('mail', local)}@{cased('domain', name)}.{last}"


def secret(key, m):
    value = regex.search("[A-Za-z0-9+/_-]{8,}$", m)[0]
    return m[: len(m) - len(value)] + moved_text(key, "secret", value)


def access_key(key, m):
    return m[:4] + moved_text(key, "access_key", m[4:])


WAYS = (secret, access_key, mail, iban, date, named_date, address, phone, other_phone, social, card)
WHOLE = [(kind, regex.compile(JAVA(pattern)), f) for (kind, pattern, _), f in zip(p.KINDS, WAYS, strict=True)]
CANDIDATE = regex.compile(JAVA(p.CANDIDATE))


def pseudonymised(key, text):
    if text is None:
        return None, [], []
    out, at, kinds, found = [], 0, [], []
    for m in CANDIDATE.finditer(text):
        kind, f = next(((k, f) for k, w, f in WHOLE if w.fullmatch(m[0])), (None, None))
        new = f(key, m[0]) if f else None
        if new is not None:
            kinds.append(kind)
            found.append(new)
        out += [text[at : m.start()], m[0] if new is None else new]
        at = m.end()
    return "".join([*out, text[at:]]), kinds, found


def planted(rnd):
    """A value, right or a little wrong, of any kind."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcXYZ019": "".join(rnd.choice(of) for _ in range(k))
    sep = rnd.choice("-/.")
    month = rnd.choice(rnd.choice(rnd.choice(list(p.MONTHS.values()))))
    month = rnd.choice((month, month.upper(), month.capitalize()))
    day, year = rnd.randrange(0, 33), rnd.randrange(1890, 2110)
    d = n(rnd.choice((12, 14, 15, 18)))
    whole = d + rnd.choice([c for c in "0123456789" if luhn(d + c) == 0] + ["7"])
    account = letters(4, "ABCD") + n(14)
    right = f"GB{98 - number97(account + 'GB00'):02d}{account}"
    return rnd.choice((
        f"password{rnd.choice((': ', '=', ' = '))}{letters(rnd.randrange(7, 70))}", f"AKIA{letters(16, 'ABCXYZ0189')}", f"{letters(rnd.randrange(1, 9))}.Jo+{n(2)}@{letters(4)}.{letters(3, 'abC')}.org", right,
        " ".join(right[k : k + 4] for k in range(0, 22, 4)), f"DE{n(20)}", f"{year}{sep}{rnd.randrange(14):02d}{sep}{day:02d}", f"{day:02d}{sep}{rnd.randrange(14):02d}{sep}{year}", f"{rnd.randrange(14):02d}/{day:02d}/{n(2)}",
        f"{day}{rnd.choice(('', 'st', 'th', 'er', '.'))} {month} {year}", f"{day} de {month} de {year}", f"{month} {day}{rnd.choice((',', 'th,', ''))} {year}", ".".join(str(rnd.randrange(300)) for _ in range(4)),
        f"({n(3)}) {n(3)}-{n(4)}", f"+1 {n(3)}-{n(3)}-{n(4)}", f"+{rnd.choice(('44', '1', '353', '7'))} {n(4)} {n(3)} {n(3)}", f"00{rnd.choice(('49', '33'))} {n(9)}", f"0{rnd.randrange(1, 10)} {n(2)} {n(2)} {n(2)} {n(2)}", f"2{n(2)}3{n(6)}",
        f"{n(3)}-{n(2)}-{n(4)}", whole, " ".join(whole[k : k + 4] for k in range(0, 16, 4)) if len(whole) == 16 else whole, n(rnd.randrange(1, 25)),
    ))


def test_planted_values(spark):
    rnd = random.Random(11)
    texts = [rnd.choice((" ", ", ", "; ", "\n", " and ")).join(planted(rnd) for _ in range(rnd.randrange(1, 7))) for _ in range(1_500)] + ["", None, "no value", "x" * 10_000 + " 1.2.3.4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.text, [f.kind for f in r.found], [f.pseudonym for f in r.found]) for r in p.pseudonymised(d, "k").collect()}
    seen = set()
    for k, text in enumerate(texts):
        want = pseudonymised("k", text)
        assert got[k] == want, text
        seen |= set(want[1])
    assert seen == {k for k, _, _ in p.KINDS}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query_and_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = p.op3_pseudonyms(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, kinds, found = pseudonymised("kinloom-test-key", texts[r.doc_id])
        assert (r.text, r.kinds, r.pseudonyms, r.n_found) == (text, kinds, found, len(found))
    stage = dict(corpus_pipeline.STAGES)["pii"](spark, docs, DATA)
    want = {r.doc_id: r.text for r in rows}
    assert {r.doc_id: r.text for r in stage.collect()} == want and stage.columns == docs.columns
