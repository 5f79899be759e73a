"""Sequence text: cleaning, complement, composition, ids.  Everything is a built-in expression inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGTN"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The 52 letters dealt over A, C, G, T in turn, starting anew at a and at A.
_BASES = ("ACGT" * 7)[:26] * 2


def clean(c: Column) -> Column:
    """Drops space, tab, CR, LF; raises acgtn; every other code point becomes N."""
    c = F.translate(F.regexp_replace(c, "[ \t\r\n]", ""), "acgtn", "ACGTN")
    return F.regexp_replace(c, "[^ACGTN]", "N")


def recode_letters(c: Column) -> Column:
    """A sequence out of any text: letters dealt over the four bases, everything else dropped."""
    return F.translate(F.regexp_replace(c, "[^A-Za-z]", ""), _LETTERS, _BASES)


def reverse_complement(c: Column) -> Column:
    """Lower case is complemented in lower case."""
    return F.reverse(F.translate(c, "ACGTNacgtn", "TGCANtgcan"))


def reverse_complement_upper(c: Column) -> Column:
    """Complements upper case only; lower case passes through."""
    return F.reverse(F.translate(c, "ACGTN", "TGCAN"))


def occurrences(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are among ``chars``."""
    return (F.char_length(c) - F.char_length(F.translate(c, chars, ""))).cast("long")


def gc_fraction(c: Column) -> Column:
    """GC over ACGT; null without any of them."""
    return F.try_divide(occurrences(c, "GC").cast("double"), occurrences(c, "ACGT").cast("double"))


def prompt_reason(c: Column, least: int = 64) -> Column:
    """null for a usable prompt, else why not; all white space of Unicode is dropped before the tests."""
    s = prompt(c)
    return F.when(F.regexp_like(s, F.lit("[^ACGTN]")), F.lit("non-ACGTN")).when(F.char_length(s) < least, F.lit("too short"))


def prompt(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\s", ""))


def outside_alphabet(c: Column) -> Column:
    """The distinct characters of ``c`` that are not in the alphabet, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), F.array(*map(F.lit, ALPHABET))))


def ids(c: Column) -> Column:
    """ASCII codes."""
    return F.transform(F.split(c, ""), lambda x: F.ascii(x))


def ids_to_text(a: Column) -> Column:
    """ids clipped to a byte; bytes over 127 are the replacement character."""
    return F.array_join(F.transform(a, lambda x: F.when(x >= 128, F.lit("�")).otherwise(F.char(F.greatest(x, F.lit(0))))), "")


def ids_to_bases(a: Column) -> Column:
    """ids of the five symbols to letters, all others N."""
    return F.array_join(F.transform(a, lambda x: F.when(x.isin(65, 67, 71, 84), F.char(x)).otherwise(F.lit("N"))), "")


def context_code(c: Column, k: int) -> Column:
    """The last k symbols as a base-5 number, padded with N on the left."""
    return F.conv(F.translate(F.lpad(F.right(c, F.lit(k)), k, "N"), ALPHABET, "01234"), 5, 10).cast("long")


def family(record: Column) -> Column:
    """First six characters of an accession without its version."""
    return F.left(F.split_part(record, F.lit("."), F.lit(1)), F.lit(6))


def rolling_hash(c: Column) -> Column:
    """h = h * 131 + code, modulo 2**32."""
    return F.aggregate(F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long")), F.lit(0).cast("long"), lambda h, x: (h * 131 + x) % 4294967296)


def run_seed(prompt_name: Column, drafter: Column, base: int) -> Column:
    return rolling_hash(F.concat(prompt_name, F.lit("|"), drafter)) % 100000 + base


def homopolymer_fraction(c: Column, least: int = 6) -> Column:
    """Share of the sequence inside runs of one symbol of ``least`` or more; 0 for an empty one."""
    runs = F.regexp_extract_all(c, F.lit("|".join(f"{b}{{{least},}}" for b in ALPHABET)), F.lit(0))
    total = F.aggregate(F.transform(runs, F.char_length), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total.cast("double"), F.char_length(c).cast("double")), F.lit(0.0))


def one_hot(c: Column) -> Column:
    """A row of four for each symbol; N gives zeros."""
    return F.transform(F.split(c, ""), lambda x: F.array(*[F.when(x == b, 1).otherwise(0) for b in "ACGT"]))


def wrap(c: Column, width: int = 80) -> Column:
    return F.regexp_replace(c, f"(.{{{width}}})(?=.)", "$1\n")


def split_point(c: Column, held: float = 0.1) -> Column:
    """Length of the training prefix when the last ``held`` of a sequence is held out."""
    return F.floor(F.char_length(c) * (F.lit(1.0) - F.lit(held))).cast("int")
