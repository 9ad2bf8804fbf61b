"""UTF-8, casing, classes, normalisation and pre-tokenisation."""

import pytest
from pyspark.sql import functions as F

from tokenlake.functions import binary as B
from tokenlake.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("code", "data"), [(0x41, b"A"), (0x130, b"\xc4\xb0"), (0x131, b"\xc4\xb1"), (0x20AC, b"\xe2\x82\xac"), (0x1F600, b"\xf0\x9f\x98\x80"), (0xD800, b""), (0x110000, b"")])
def test_codepoint_encoding(code, data):
    assert B.encode_codepoint(code) == data
    if data:
        assert list(B.codepoints(data)) == [(code, len(data))]


def test_sequence_lengths(spark):
    cases = {0x00: 1, 0x41: 1, 0x7F: 1, 0xC4: 2, 0xE2: 3, 0xF0: 4, 0x80: 1, 0xFF: 1, 0xF8: 1}
    rows = spark.createDataFrame([(k,) for k in cases], "b int").select("b", T.sequence_length(F.col("b")).alias("n")).collect()
    assert {r["b"]: r["n"] for r in rows} == cases


@pytest.mark.parametrize(("data", "chunks"), [(b"\xc0\xaf", 1), (b"\xed\xa0\x80", 1), (b"\xe2\x82", 2), (b"\x80", 1), (b"", 0), (b"ab\xff12", 3), ("a×b αβ".encode(), 4)])
def test_malformed_chunks(spark, data, chunks):
    assert len(B.split(data)) == chunks
    assert b"".join(B.split(data)) == data
    rows = spark.createDataFrame([(bytearray(data),), (None,)], "x binary")
    got = rows.select(B.pretokens_binary()(F.col("x")).alias("c")).collect()
    assert [bytes(c) for c in got[0]["c"]] == B.split(data)
    assert got[1]["c"] is None


def test_length_and_validity(spark):
    cases = {"İstanbul".encode(): (8, True), b"\xc4": (1, False), b"": (0, True), b"\xef\xbf\xbd": (1, False), b"\xc0\xaf": (1, False)}
    for data, (n, ok) in cases.items():
        assert (B.length(data), B.valid(data)) == (n, ok)
        assert one(spark, bytearray(data), T.is_clean_utf8, "binary") is ok


@pytest.mark.parametrize(("upper", "lower"), [("İ", "i"), ("I", "ı"), ("A", "a"), ("Z", "z"), ("Ç", "ç"), ("Ş", "ş"), ("Ğ", "ğ"), ("Ö", "ö"), ("Ü", "ü"), ("5", "5"), ("!", "!")])
def test_casing(spark, upper, lower):
    assert one(spark, upper, T.turkish_lower) == lower
    assert one(spark, lower, T.turkish_upper) == upper


def test_casing_leaves_other_letters(spark):
    assert one(spark, "ÉЖ", T.turkish_lower) == "ÉЖ"
    assert one(spark, "ISTANBUL", T.turkish_lower) == "ıstanbul"


@pytest.mark.parametrize(("char", "kind"), [(" ", "space"), ("\n", "space"), (" ", "space"), ("​", "space"), ("\u0085", "other"), ("a", "letter"), ("İ", "letter"), ("×", "letter"), ("٣", "letter"), ("α", "other"), ("ª", "other"), ("7", "digit"), (".", "other"), ("漢", "letter")])
def test_category(spark, char, kind):
    assert one(spark, char, T.category) == kind


def test_punctuation(spark):
    assert [one(spark, c, T.is_punctuation) for c in ".,!—a "] == [True, True, True, True, False, False]


@pytest.mark.parametrize(
    ("text", "flags", "out"),
    [
        ("hello   world\t\nnew", T.Norm.WHITESPACE, "hello world new"),
        ("İSTANBUL", T.Norm.LOWERCASE, "istanbul"),
        ("é é", T.Norm.STRIP_ACCENTS, "e é"),
        ("é", T.Norm.NFC, "é"),
        ("  Á　B ", T.Norm.STRIP_ACCENTS | T.Norm.LOWERCASE | T.Norm.WHITESPACE, " a b "),
        ("", T.Norm.WHITESPACE, ""),
        (None, T.Norm.WHITESPACE, None),
    ],
)
def test_normalize(spark, text, flags, out):
    assert one(spark, text, lambda c: T.normalize(c, flags)) == out


def test_flags():
    assert T.parse_flags("wla") == T.Norm.WHITESPACE | T.Norm.LOWERCASE | T.Norm.STRIP_ACCENTS
    with pytest.raises(ValueError, match="x"):
        T.parse_flags("wx")


@pytest.mark.parametrize(("text", "chunks"), [("Hello, world! 123", ["Hello", ",", " ", "world", "!", " ", "123"]), ("Merhaba!", ["Merhaba", "!"]), ("a×b", ["a×b"]), ("αβ", ["α", "β"]), ("...", [".", ".", "."]), ("a​ b", ["a", "​ ", "b"]), ("", [])])
def test_pretokens(spark, text, chunks):
    assert one(spark, text, T.pretokens) == chunks
    assert [c.decode() for c in B.split(text.encode())] == chunks
