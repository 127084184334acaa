"""Text functions as Column expressions: normalisers, tokens, keys, contexts. No Python UDFs here."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def accent_table(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one plain character, and that character (rule: NFD without marks)."""
    pairs = [(chr(c), base) for c in range(first, last + 1) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) == 1 and base != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = accent_table()
MARKS = r"[̀-ͯ]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(c) -> Column:
    """Accents off: precomposed Latin letters by table, then loose combining marks."""
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), MARKS, "")


def squeeze(c) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), "^ | $", "")


def fold_text(c) -> Column:
    """For comparing versions: accents off, lower case, white space squeezed."""
    return squeeze(F.lower(strip_accents(c)))


def plain_lower(c) -> Column:
    """For matching segments: lower case, white space squeezed, accents kept."""
    return squeeze(F.lower(col(c)))


def header_key(c) -> Column:
    """A column header reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"(?U)[^\p{Alnum}]", "")


def collapsed(c) -> Column:
    """Only a-z and 0-9 stay."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def words(c) -> Column:
    """Unicode words, in order."""
    return F.regexp_extract_all(col(c), F.lit(r"((?U)\w+)"), F.lit(1))


def camel_parts(c) -> Column:
    """Sub-tokens of a camel-case token."""
    return F.regexp_extract_all(col(c), F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))


def messy_int(c) -> Column:
    """The integer of a cell such as ``31`` or ``31.0``; null if it isn't one."""
    return F.try_to_number(F.regexp_extract(F.trim(col(c)), r"^(-?[0-9]{1,9})(?:\.[0-9]*)?$", 1), F.lit("S999999999")).cast("int")


def entity_key(c) -> Column:
    """An entity's name for lookups: accents off, lower case, one space, no spaces or stops at the ends."""
    return F.regexp_replace(squeeze(F.lower(strip_accents(c))), r"^[ .;,]+|[ .;,]+$", "")


def acronym(c, longest: int = 20) -> Column:
    """An acronym reduced to ASCII letters and digits, ``longest`` at most."""
    return F.left(F.regexp_replace(strip_accents(c), "[^A-Za-z0-9]", ""), F.lit(longest))


def lineage(code) -> Column:
    """The first two dotted parts of a code."""
    return F.array_join(F.slice(F.split(col(code), r"\."), 1, 2), ".")


def numeric_order(code) -> Column:
    """A dotted code as an array of numbers, which sorts as the code should."""
    return F.transform(F.split(col(code), r"\."), lambda x: F.coalesce(F.try_to_number(F.regexp_extract(x, "^[0-9]{1,9}$", 0), F.lit("999999999")).cast("int"), F.lit(0)))


def type_key(c) -> Column:
    """A document type: upper case, without accents, spaces or hyphens at the ends, one space between."""
    return F.regexp_replace(squeeze(F.upper(strip_accents(c))), r"\s*-\s*", "-")


def yearly_number(c) -> Column:
    """The running number of ``nnn/yyyy`` or of plain digits."""
    return F.coalesce(*[F.when(F.regexp_extract(col(c), p, 1) != "", F.regexp_extract(col(c), p, 1).cast("int")) for p in (r"^\s*(\d{1,6})/\d{4}\s*$", r"^\s*(\d{1,6})\s*$")])


def looks_reversed(word: Column) -> Column:
    """A word read backwards: lower case, then one capital at the end, four letters or more."""
    return word.rlike("^[a-zà-ÿ]{3,}[A-ZÀ-Ý]$")


def in_context(text, word, width: int = 70) -> Column:
    """A word's first occurrence with ``width`` characters on either side; dots mark a cut."""
    text, word = col(text), col(word)
    at = F.instr(text, word)
    start = F.greatest(at - width, F.lit(1))
    end = F.least(at + F.length(word) - 1 + width, F.length(text))
    found = F.concat(F.when(start > 1, "…").otherwise(""), F.replace(F.substr(text, start, end - start + 1), F.lit("\n"), F.lit(" ⏎ ")), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, found).otherwise("")


def char_classes(c) -> dict[str, Column]:
    """How many letters, digits, commas, stops and letters a (either case) a text has."""
    c = col(c)
    count = lambda pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return {"letters": count(r"\p{L}"), "digits": count(r"\p{Nd}"), "commas": count(","), "stops": count(r"\."), "a": count("[aA]")}


def code_path(code) -> Column:
    """``REVIEW/4.08.4.1`` -> [REVIEW, 4.08, 4.08.4, 4.08.4.1]: a band, then every prefix of two dotted parts or more."""
    parts = F.split(col(code), "/")
    spread = lambda p: F.when(
        p.rlike(r"^[0-9]+(\.[0-9]+)+$"),
        F.transform(F.sequence(F.lit(2), F.size(F.split(p, r"\."))), lambda n: F.array_join(F.slice(F.split(p, r"\."), F.lit(1), n), ".")),
    ).otherwise(F.array(p))
    path = F.flatten(F.transform(parts, spread))
    return F.filter(path, lambda x, i: (i == 0) | (F.get(path, i - 1) != x))


def json_array(reply) -> Column:
    """The outermost [...] of a model's reply, empty if there is none."""
    return F.regexp_extract(col(reply), r"(?s)(\[.*\])", 1)


def padded_replace(c, pattern: str, filler: str) -> Column:
    """Replace every match of a fixed-length pattern by ``filler`` (of that length), so offsets stay valid."""
    return F.regexp_replace(col(c), pattern, filler)


#: Ordinal stems and their values. Portuguese ordinals, as the documents spell them.
ORDINALS = {
    "centesim": 100, "nonagesim": 90, "octogesim": 80, "septuagesim": 70, "setuagesim": 70, "sexagesim": 60,
    "quinquagesim": 50, "quadragesim": 40, "trigesim": 30, "vigesim": 20, "decim": 10,
    "primeir": 1, "segund": 2, "terceir": 3, "quart": 4, "quint": 5, "sext": 6, "setim": 7, "oitav": 8, "non": 9,
}


def spelled_ordinal(c) -> Column:
    """``décima segunda`` -> 12. Values must fall strictly from word to word; any other word gives null."""
    found = F.regexp_extract_all(F.lower(strip_accents(c)), F.lit("([a-z]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    values = F.transform(found, lambda w: F.try_element_at(table, F.regexp_replace(w, "[ao]$", "")))
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.coalesce(F.get(values, i) < F.get(values, i - 1), F.size(values) < 2))
    good = (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull()) & falls
    return F.when(good, F.aggregate(values, F.lit(0), lambda a, v: a + v))


def number_key(label) -> Column:
    """A clause's or article's number from its label, as a key that is the same for all spellings.

    cl12 (digits or spelled), cl16A (with an inserted letter), arunico, clprevia, clrevisao, clVII-8 (roman); null without one.
    """
    plain = strip_accents(label)
    low = F.lower(plain)
    shape = r"^\s*(clausula|artigo)\s+(.+?)\s*(?:\s-\s.*)?$"
    kind, number = F.left(F.regexp_extract(low, shape, 1), F.lit(2)), F.regexp_extract(low, shape, 2)
    raw = F.substr(plain, F.length(F.regexp_extract(low, r"^(\s*(?:clausula|artigo)\s+)", 1)) + 1, F.length(number))
    digits, letter = F.regexp_extract(number, r"^(\d+)\s*\.?\s*[ªº]?(?:\s*-\s*([a-z])\b)?", 1), F.regexp_extract(number, r"^(\d+)\s*\.?\s*[ªº]?(?:\s*-\s*([a-z])\b)?", 2)
    roman = r"^([IVXLC]+)(?:\s*-\s*(\d+))?(?![A-Za-z])"
    first = F.split(number, r"\s+")
    spelled = F.coalesce(*[spelled_ordinal(F.array_join(F.slice(first, 1, n), " ")) for n in (3, 2, 1)])
    key = (
        F.when(digits != "", F.concat(F.regexp_replace(digits, "^0+(?=.)", ""), F.upper(letter)))
        .when(number.rlike(r"^unic[oa]\b"), "unico")
        .when(number.rlike(r"^(previ[oa]|preliminar)\b"), "previa")
        .when(number.rlike(r"^de\s+revisao\b"), "revisao")
        .when(F.regexp_extract(raw, roman, 1) != "", F.concat(F.regexp_extract(raw, roman, 1), F.when(F.regexp_extract(raw, roman, 2) != "", F.concat(F.lit("-"), F.regexp_replace(F.regexp_extract(raw, roman, 2), "^0+(?=.)", ""))).otherwise("")))
        .when(spelled.isNotNull(), spelled.cast("string"))
    )
    return F.when(kind != "", F.concat(kind, key))
