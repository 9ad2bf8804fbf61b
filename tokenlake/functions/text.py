"""Casing, character classes, normalisation and pre-tokenisation as column expressions.

All of them stay in the JVM and in whole-stage code generation; none needs a
shuffle.  Patterns are written with escapes, so that their SQL counterparts can
be derived from the same tables of ranges.
"""

from __future__ import annotations

import warnings
from enum import IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Turkish casing: dotted and dotless i are different letters; anything not listed stays.
_TO_LOWER = ("İI" + UPPER.replace("I", "") + "ÇÖÜŞĞ", "iı" + LOWER.replace("i", "") + "çöüşğ")
_TO_UPPER = ("iı" + LOWER.replace("i", "") + "çöüşğ", "İI" + UPPER.replace("I", "") + "ÇÖÜŞĞ")

Ranges = list[tuple[int, int]]
LETTER: Ranges = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x400, 0x4FF), (0x600, 0x6FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)]
DIGIT: Ranges = [(0x30, 0x39)]
SPACE: Ranges = [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
PUNCTUATION: Ranges = [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0x2000, 0x206F), (0x3000, 0x303F)]
ACCENT: Ranges = [(0x300, 0x36F)]


def char_class(ranges: Ranges, negate: bool = False) -> str:
    """A regular expression class that Java and RE2 read alike."""
    return f"[{'^' * negate}{''.join(rf'\x{{{a:X}}}' + (rf'-\x{{{b:X}}}' if b > a else '') for a, b in ranges)}]"


#: Maximal runs of letters, of digits and of white space; any other character by itself.
PRETOKEN = f"{char_class(LETTER)}+|{char_class(DIGIT)}+|{char_class(SPACE)}+|(?s:.)"


class Norm(IntFlag):
    """Normalisation flags; ``NFC`` is accepted and does nothing, as composed text is made by cleaning."""

    NONE = 0
    LOWERCASE = 1
    NFC = 2
    STRIP_ACCENTS = 4
    WHITESPACE = 8


def parse_flags(letters: str, strict: bool = True) -> Norm:
    """Flags from the letters w (white space), l (lower case) and a (accents); others raise, or warn where not ``strict``."""
    known = {"w": Norm.WHITESPACE, "l": Norm.LOWERCASE, "a": Norm.STRIP_ACCENTS}
    out = Norm.NONE
    for c in letters:
        if c not in known:
            if strict:
                raise ValueError(f"unknown normalisation flag {c!r}; known: w, l, a")
            warnings.warn(f"normalisation flag {c!r} is not known and has no effect", stacklevel=2)
        out |= known.get(c, Norm.NONE)
    return out


def turkish_lower(text: Column) -> Column:
    return F.translate(text, *_TO_LOWER)


def turkish_upper(text: Column) -> Column:
    return F.translate(text, *_TO_UPPER)


def strip_accents(text: Column) -> Column:
    """Drop combining accents; composed letters stay."""
    return F.regexp_replace(text, char_class(ACCENT), "")


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one space; nothing is trimmed."""
    return F.regexp_replace(text, char_class(SPACE) + "+", " ")


def normalize(text: Column, flags: Norm = Norm.WHITESPACE) -> Column:
    """Accents, then case, then white space, as far as the flags say."""
    if flags & Norm.STRIP_ACCENTS:
        text = strip_accents(text)
    if flags & Norm.LOWERCASE:
        text = turkish_lower(text)
    return collapse_space(text) if flags & Norm.WHITESPACE else text


def is_letter(char: Column) -> Column:
    return char.rlike(f"^{char_class(LETTER)}")


def is_digit(char: Column) -> Column:
    return char.rlike(f"^{char_class(DIGIT)}")


def is_space(char: Column) -> Column:
    return char.rlike(f"^{char_class(SPACE)}")


def is_punctuation(char: Column) -> Column:
    return char.rlike(f"^{char_class(PUNCTUATION)}")


def category(char: Column) -> Column:
    """Class of a text's first character: letter before digit before space before other."""
    return F.when(is_letter(char), "letter").when(is_digit(char), "digit").when(is_space(char), "space").otherwise("other")


def pretokens(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"({PRETOKEN})"), F.lit(1))


def byte_string(text: Column) -> Column:
    """One character for each UTF-8 byte, with the byte's value as its code."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_byte_string(text: Column) -> Column:
    """The bytes of a byte string."""
    return F.encode(text, "ISO-8859-1")


def sequence_length(first_byte: Column) -> Column:
    """Length of a UTF-8 sequence by its first byte (0 to 255); 1 for a byte that cannot be first."""
    return F.when(first_byte.between(0xC0, 0xDF), 2).when(first_byte.between(0xE0, 0xEF), 3).when(first_byte.between(0xF0, 0xF7), 4).otherwise(1)


def encode_codepoint(code: Column) -> Column:
    """UTF-8 of a code point as binary; empty for surrogates and numbers that are none."""
    c = code.cast("int")

    def tail(shift: int) -> Column:
        return F.shiftright(c, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))

    def joined(*parts: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(p.cast("long")), 2, "0") for p in parts]))

    two = joined(F.shiftright(c, 6).bitwiseOR(F.lit(0xC0)), tail(0))
    three = joined(F.shiftright(c, 12).bitwiseOR(F.lit(0xE0)), tail(6), tail(0))
    four = joined(F.shiftright(c, 18).bitwiseOR(F.lit(0xF0)), tail(12), tail(6), tail(0))
    bad = (c < 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF)
    return F.when(bad, F.unhex(F.lit(""))).when(c < 0x80, joined(c)).when(c < 0x800, two).when(c < 0x10000, three).otherwise(four)


def is_clean_utf8(data: Column) -> Column:
    """Whether a binary or text value is valid UTF-8 without any U+FFFD, which counts as damage."""
    text = data.cast("string")
    return F.is_valid_utf8(text) & ~F.contains(text, F.lit("\ufffd"))
