"""String functions as Column expressions. Character classes follow Unicode; `.` stops at a line feed only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Inc", "Ltd", "Jr", "Sr"]
# The punctuation that normalisation deletes, and the auxiliaries that a predicate may begin with.
PUNCTUATION = "\"'`,.;:!?()[]{}"
AUXILIARIES = ["is", "was", "are", "were", "be"]

_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


#: Unicode's white space, one by one and as a class.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def norm_text(c: Column) -> Column:
    """Stripped, lower case, single spaces; punctuation is deleted last, so it may leave spaces behind."""
    return F.regexp_replace(collapse(F.lower(strip(c))), _CLASS, "")


def canon_predicate(c: Column) -> Column:
    return F.regexp_replace(F.replace(norm_text(c), F.lit(" "), F.lit("_")), f"^({'|'.join(AUXILIARIES)})_", "")


def cache_key(c: Column) -> Column:
    return strip(F.lower(c))


def signature(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", *[collapse(strip(F.lower(x))) for x in (s, p, o)])


def claim_id(s: Column, p: Column, o: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", s, p, o).cast("binary")), 1, 12)


def keywords(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def sentences(c: Column) -> Column:
    """The sentences of a text, stripped, none empty."""
    text, short = strip(c), "|".join(ABBREVIATIONS)
    safe = F.when(text.rlike(rf"(?:{short})\.{SPACE}"), F.regexp_replace(text, rf"(?U)\b({short})\.\s", "$1<PERIOD> ")).otherwise(text)
    parts = F.split(safe, rf"{SPACE}(?<=[.!?]{SPACE}){SPACE}*")
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("<PERIOD>"), F.lit(".")))), lambda p: p != "")


def percent(c: Column) -> Column:
    """A share as whole per cents, half to even on the binary value."""
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def hash_tokens(c: Column) -> Column:
    """Words of [a-z0-9_], then adjacent pairs."""
    clean = strip(collapse(F.regexp_replace(F.lower(c), "[^a-z0-9_ ]+", " ")))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(words, pairs)


def bucket(c: Column, dim: int = 512) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def json_array(c: Column) -> Column:
    """The widest [...] of a reply, '' if there is none."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)
