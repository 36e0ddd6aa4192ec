"""Text of queries, descriptions and sequences."""

from __future__ import annotations

from unicodedata import combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What queries lose, and what a token of a query is. Fixed values.
UNSAFE = r"[;:{}()*<>'\"`\\|?%#=\[\]^$@!~/&+]"
TOKEN = r"([A-Za-z0-9]{2,})"
#: A term of an indexed text: letters and digits of any script.
TERM = r"([\p{L}\p{N}\p{Co}]+)"
#: Words for a missing value in annotation files. Fixed values.
MISSING = ("null", "none", "na", "n/a", ".")
#: Words for a missing number in expression files, in upper case. Fixed values.
MISSING_NUMBERS = ("", "NA", "NAN", "NULL", ".")


def cleaned_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNSAFE, ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def _plain_letters() -> tuple[str, str]:
    """Accented letters, and the letters that they are without their marks, by the canonical decompositions of Unicode."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        whole = chr(code)
        base = "".join(x for x in normalize("NFD", whole) if not combining(x))
        if base != whole and len(base) == 1:
            pairs[whole] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain_letters()


def folded(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def terms(c: Column) -> Column:
    """The terms under which a text is indexed, in order: runs of letters and digits, lower case, without diacritics."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(1))


def alias_terms(c: Column) -> Column:
    return F.filter(F.array_distinct(F.concat(F.array(F.lower(F.trim(c))), F.transform(tokens(c), F.lower))), lambda x: x != "")


def present(c: Column) -> Column:
    """The trimmed value; empty for a missing one."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), "").otherwise(t)


def number(c: Column) -> Column:
    """A number with or without thousands commas; null for what is none."""
    return F.replace(present(c), F.lit(","), F.lit("")).try_cast("double")


def measurement(c: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(~t.isin(*MISSING_NUMBERS), t.try_cast("double"))


def listed(c: Column) -> Column:
    """Parts between commas, semicolons, bars and slashes, without blanks, words for missing values and repetitions, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(present(c), r"[,;|/]"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*MISSING)))


def piped(a: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))), "|")


def sentences(*parts: Column) -> Column:
    """Parts joined by a blank after a full stop and by a full stop and a blank otherwise."""
    full = F.filter(F.transform(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    glue = lambda acc, x: F.when(acc == "", x).when(F.rtrim(acc).endswith("."), F.concat(F.rtrim(acc), F.lit(" "), x)).otherwise(F.concat(acc, F.lit(". "), x))
    return F.aggregate(full, F.lit(""), glue)


def snippet(text: Column, tokens: list[str], width: int = 140) -> Column:
    """The text from a third of the width before the first token that it has to a width after its start; dots for what is cut off at
    either side. The tokens are tried in order; a text without any shows its beginning."""
    n = F.length(text)
    dots = lambda more: F.when(more, "...").otherwise("")
    out = F.concat(F.substring(text, 1, width), dots(n > width))
    for t in reversed(tokens):
        at = F.instr(F.lower(text), F.lit(t.lower()))
        begin = F.greatest(F.lit(0), at - 1 - width // 3)
        end = F.least(n, at - 1 + width)
        out = F.when(at > 0, F.concat(dots(begin > 0), F.substring(text, begin + 1, end - begin), dots(end < n))).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(out)


def like_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width))


def protein(seq: Column) -> Column:
    return F.replace(seq, F.lit("*"), F.lit(""))


def coding(seq: Column) -> Column:
    return F.rtrim(F.upper(seq), F.lit("*"))


def ungapped(seq: Column) -> Column:
    return F.regexp_replace(seq, r"[.\-]", "")


def fitted_structure(structure: Column, seq: Column) -> Column:
    """A structure string cut or filled with - to the length of the sequence without gaps."""
    n = F.length(ungapped(seq))
    return F.rpad(F.substring(structure, F.lit(1), n), n, F.lit("-"))


def three_states(structure: Column) -> Column:
    return F.translate(F.upper(structure), "EC-. ", "SLLLL")


def hashable(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), r"[ \n]", "")


def content_id(seq: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(hashable(seq).cast("binary"), 256), 1, 16))


def significant(x: Column, digits: int = 4) -> Column:
    """A number of 0.01 or more with so many significant digits, without zeros at its end; powers of ten beyond them as an exponent."""
    whole = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(whole, "e(.*)$", 1).cast("int")
    plain = F.lit(None).cast("string")
    for p in range(-2, digits):
        plain = F.when(power == p, F.format_string(f"%.{digits - 1 - p}f", x)).otherwise(plain)
    short = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    return F.when(power >= digits, F.concat(short(F.regexp_extract(whole, "^(.*)e", 1)), F.regexp_extract(whole, "(e.*)$", 1))).otherwise(short(plain))


def evalue_label(e: Column) -> Column:
    """A dash for none, 0, two decimals and an exponent below a hundredth (one decimal at the end of the range), four digits above."""
    size = F.abs(e)
    small = F.when(size < 1e-300, F.format_string("%.1e", e)).otherwise(F.format_string("%.2e", e))
    return F.when(e.isNull(), "—").when(e == 0, "0").when(size >= 0.01, significant(e)).otherwise(small)


def identity_label(p: Column) -> Column:
    return F.when(p.isNull(), "—").otherwise(F.format_string("%.1f%%", p))


def fdr_label(q: Column) -> Column:
    """Two decimals and a short exponent below a hundredth, three decimals below one, two above; empty for none."""
    power = F.regexp_replace(F.format_string("%.2e", q), r"e([+-])0(\d)$", "e$1$2")
    return F.when(q.isNull() | F.isnan(q), "").when(q < 0.01, power).when(q < 1, F.format_string("%.3f", q)).otherwise(F.format_string("%.2f", q))


def quoted_cell(c: Column) -> Column:
    """A cell of an export: in quotes, those inside doubled, if it has a tab, a quote or a line end; empty for null."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def templated(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by each value; empty for a missing one."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def palette_slot(key: Column, size: int = 77) -> Column:
    """A fixed colour slot of a trimmed key: the first two bytes of its md5 modulo the palette; -1 for a blank key or a dash."""
    blank = (F.trim(F.coalesce(key, F.lit(""))) == "") | (F.trim(key) == "—")
    return F.when(blank, -1).otherwise(F.conv(F.substring(F.md5(F.trim(key).cast("binary")), 1, 4), 16, 10).cast("int") % size)
