"""Text, unit, date and number rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura import constants as C

#: Every white space but the space is one of these bytes or begins with them; letters and digits of ASCII and Cyrillic have none.
SPACE_BYTES = (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, by the Unicode library that Spark itself uses for collations."""
    form = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNotNull(), form)


def needs_nfkc(text: Column) -> Column:
    """False where the compatibility form surely is the text itself."""
    plain = F.rlike(text, F.lit("^[\\x00-\\x7F\\u0400-\\u045F]*\\z"))  # most texts, in one quick run
    return ~plain & (F.rlike(text, F.lit("[^\\x00-\\x7F\\u0400-\\u045F\\u00AB\\u00BB\\u2010\\u2012-\\u2014\\u2018-\\u201E\\u2116]")) | text.contains("№"))


def canonical(text: Column) -> Column:
    """Lower case, е for ё, without amounts, punctuation and repeated spaces.

    Expects compatibility form where ``needs_nfkc`` holds.
    """
    s = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    s = F.regexp_replace(s, r"(?U)\d+([.,]\d+)?\s*(м2|м3|шт|кг|л|м)\b", "")
    plain = F.rlike(s, F.lit("^[a-zа-я0-9 ]*\\z")) & ~s.contains("  ")
    return F.coalesce(F.trim(F.when(plain, s).otherwise(F.regexp_replace(s, "[^a-zа-я0-9]+", " "))), F.lit(""))


def odd_space(text: Column) -> Column:
    """False where the only white space surely is the space; looks for bytes, which costs much less than a pattern."""
    of_bytes = text.cast("binary")
    return reduce(lambda a, b: a | F.contains(of_bytes, F.lit(b)), SPACE_BYTES[1:], F.contains(of_bytes, F.lit(SPACE_BYTES[0])))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.when(odd_space(text), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(F.trim(text))


def tidy(text: Column) -> Column:
    """Trimmed, single spaces."""
    plain = F.when(text.contains("  "), F.regexp_replace(F.trim(text), " {2,}", " ")).otherwise(F.trim(text))
    return F.when(odd_space(text), F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")).otherwise(plain)


def unless_junk(text: Column, junk: tuple[str, ...] = C.JUNK_VALUES) -> Column:
    """Empty for null and for words that say nothing."""
    short = F.char_length(text) <= max(map(len, junk))
    return F.when(text.isNull() | (short & F.lower(text).isin(*junk)), "").otherwise(text)


def clean(text: Column, junk: tuple[str, ...] = C.JUNK_VALUES) -> Column:
    """Trimmed, single spaces, and empty for null and for words that say nothing."""
    return unless_junk(tidy(text), junk)


def unit_name(unit: Column) -> Column:
    """The common spelling of a unit; dots at the end don't count."""
    table = F.create_map(*[F.lit(x) for pair in C.UNITS.items() for x in pair])
    u = F.rtrim(strip(F.lower(unit)), F.lit("."))
    return F.coalesce(table[u], u, F.lit(""))


def parse_date(text: Column, formats: tuple[str, ...] = C.DATE_FORMATS) -> Column:
    """A date of any accepted format, or null. Two-digit years from 69 on are 19xx."""
    s = F.trim(text)
    tried = []
    for form in formats:
        day = F.to_date(F.try_to_timestamp(s, F.lit(form)))
        if "yyyy" not in form:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tried.append(F.when(F.rlike(s, F.lit(_date_pattern(form))), day))
    return F.coalesce(*tried)


def _date_pattern(form: str) -> str:
    """What the parser reads, but for a 29 February of other years: where it fails it throws, which costs more than all else here."""
    fields = {"y": r"\d{4}" if "yyyy" in form else r"\d{2}", "M": "(?:0?[1-9]|1[0-2])", "d": "(?:0?[1-9]|[12][0-9]|3[01])"}
    written = lambda **of: "".join((fields | of).get(c, "\\" + c) for c in _letters(form)) + r"\z"
    return f"^(?!{written(M='0?2', d='3[01]')}|{written(M='(?:0?[469]|11)', d='31')}){written()}"


def _letters(form: str) -> str:
    return reduce(lambda out, c: out if out.endswith(c) else out + c, form, "")


def iso_date(text: Column) -> Column:
    return F.coalesce(parse_date(text).cast("string"), F.lit(""))


# --- numbers: variants differ in what garbage and signs become ---------------


def _spaceless(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))


def number_or_null(text: Column) -> Column:
    """Digits, dot and minus are kept; garbage and negative values are null."""
    return not_negative(F.regexp_replace(_spaceless(text.cast("string")), r"[^0-9.\-]", "").try_cast("double"))


def not_negative(value: Column) -> Column:
    return F.when((value >= 0) & ~F.isnan(value), value)


def cell_number(text: Column) -> Column:
    """A table cell: ``350-00`` is 350; a minus sign is lost."""
    s = F.regexp_replace(F.replace(F.replace(F.trim(text.cast("string")), F.lit(" "), F.lit("")), F.lit(" "), F.lit("")), r"-\d{2}$", "")
    return F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^0-9.]", "").try_cast("double")


def number_or_zero(text: Column, strip_nbsp: bool = True) -> Column:
    """Garbage and null are 0; signs stay."""
    s = F.trim(text.cast("string"))
    s = F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    s = F.replace(s, F.lit(" "), F.lit("")) if strip_nbsp else s
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def plain_number(text: Column) -> Column:
    """Only the decimal comma is understood; garbage is null."""
    return F.replace(text.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Rounded as a binary number, halves to even: 2313.575 is a little less than it looks, so 2313.57."""
    return F.rint(value * 10.0**digits) / 10.0**digits


def round_multiple(value: Column, least: int) -> Column:
    """At least ``least`` and a multiple of it."""
    return (value >= least) & (value % least == 0)


def deviation_pct(value: Column, reference: Column) -> Column:
    """Distance from the reference in percent, two decimals; 0 for a reference of 0."""
    return F.when(reference == 0, 0.0).otherwise(F.round(F.abs((value - reference) / F.nullif(reference, F.lit(0.0)) * 100), 2))


# --- words ------------------------------------------------------------------


def words(text: Column, least: int = 1) -> Column:
    """Distinct words of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words; 0 if a side has none."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    ).otherwise(0.0)


def contractor_name(name: Column) -> Column:
    """A company name without legal form, quotes, brackets and punctuation; hyphens stay.

    Expects compatibility form where ``needs_nfkc`` holds.
    """
    s = F.replace(F.lower(name), F.lit("ё"), F.lit("е"))
    s = F.regexp_replace(s, "[«»\"'`„“”‘’]", " ")
    s = F.regexp_replace(s, r"(?U)\b(?:" + "|".join(C.LEGAL_FORMS) + r")\b", " ")
    s = F.regexp_replace(s, r"[()\[\]{}]", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s\-]", " ")
    return F.coalesce(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), F.lit(""))


def is_vague(name: Column) -> Column:
    """Nothing but general words, or a general word and no specific longer one."""
    n = F.trim(F.lower(name))
    all_words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
    vague = F.array(*[F.lit(w) for w in C.VAGUE_WORDS])
    specific = F.array_except(all_words, vague)
    said = reduce(lambda a, w: a | n.contains(w), C.VAGUE_WORDS[1:], n.contains(C.VAGUE_WORDS[0]))
    return (F.size(specific) == 0) | (said & ~F.exists(specific, lambda w: F.char_length(w) > 5))


def department_of(filename: Column) -> Column:
    """The department whose keyword a file name has, in the order of the table."""
    low = F.lower(filename)
    out = F.lit(C.UNKNOWN_DEPARTMENT)
    for word, department in reversed(C.DEPARTMENT_WORDS.items()):
        out = F.when(low.contains(word), department).otherwise(out)
    return out


def plain_filename(filename: Column) -> Column:
    """A file name without the id that an upload puts before it."""
    return F.regexp_replace(filename, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_", "")


def money(value: Column) -> Column:
    """Whole roubles with narrow spaces between thousands."""
    return F.concat(F.replace(F.format_number(F.bround(value, 0), 0), F.lit(","), F.lit(" ")), F.lit(" руб."))


def general(value: Column) -> Column:
    """A number to six significant digits, without zeros at the end; an exponent from a million on and below a ten thousandth."""
    size = F.floor(F.log10(F.nullif(F.abs(value), F.lit(0.0))))
    # The digits that rounding adds to a number just below a power of ten.
    size = F.when(F.abs(value) / F.pow(F.lit(10.0), size) >= 9.999995, size + 1).otherwise(size)
    tidy = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*[F.when(size == n, tidy(F.format_string(f"%.{5 - n}f", value))) for n in range(-4, 6)])
    mantissa = tidy(F.format_string("%.5f", value / F.pow(F.lit(10.0), size)))
    exponent = F.concat(F.when(size < 0, "e-").otherwise("e+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    return F.when(value == 0, "0").when(size.between(-4, 5), plain).otherwise(F.concat(mantissa, exponent))


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value.cast("double")), F.lit("%"))


def shorten(text: Column, limit: int = 32) -> Column:
    """Display text: longer parts are cut and end in an ellipsis."""
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)
