"""Text expressions: spacing, tokenising, tagging, joining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.split takes as whitespace.
SPACE_CLASS = (
    r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The 51 Hangul compatibility letters, and the marks added to
# them when reviews are prepared.
JAMO_CLASS = r"\x{3131}-\x{3163}"
SPACING_MARKS = ["!", "~", ".", ";", ":"]

# A token is a run of letters, a run of digits, or one sign.
TOKEN_PATTERN = r"(\p{L}+|[0-9]+|[^\p{L}0-9\x00-\x20\x7F-\xA0])"
SIGN_CLASS = r"[^\p{L}0-9\x00-\x20\x7F-\xA0]"

# Signs by tag (sentence end, separator, bracket or quote,
# ellipsis, range); any other sign is SW.
SIGN_TAGS = {
    "SF": [".", "?", "!"],
    "SP": [",", ":", ";", "/"],
    "SS": ["\"", "'", "(", ")", "[", "]", "{", "}", "<", ">"],
    "SE": ["…"],
    "SO": ["-", "~"],
}
UNKNOWN_TAGS = ["NA", "UNKNOWN"]

Tokenizer = Callable[[Column], Column]


def words(text: Column | str) -> Column:
    """Whitespace tokens of a text, as Python's str.split gives them."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def spacing(text: Column | str, marks: list[str] = ()) -> Column:
    """Put a blank at each border between the class and other characters.

    The class is the Hangul letters plus `marks`.
    """
    c = JAMO_CLASS + "".join(f"\\x{{{ord(m):X}}}" for m in marks)
    border = f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])"
    return F.regexp_replace(text, border, " ")


def strip_signs(text: Column | str) -> Column:
    """Drop every sign and squeeze the blanks left; sign-free text is kept."""
    col = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(col, SIGN_CLASS, ""), " {2,}", " ")
    return F.when(col.rlike(SIGN_CLASS), bare).otherwise(col)


def lexemes(text: Column | str) -> Column:
    """Letter runs, digit runs and single signs, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def _starts(lex: Column, first: str, last: str) -> Column:
    """True if the first character lies between two ASCII characters."""
    return (lex >= F.lit(first)) & (lex < F.lit(chr(ord(last) + 1)))


def sign_tag(lex: Column) -> Column:
    """Tag of a non-letter token, NULL for letters.

    ASCII letters and digits are told by comparison; only what is left meets a
    regular expression.
    """
    letter = F.lit(None).cast("string")
    tag = (F.when(_starts(lex, "a", "z") | _starts(lex, "A", "Z"), letter)
           .when(_starts(lex, "0", "9"), F.lit("SN")))
    for name, signs in SIGN_TAGS.items():
        tag = tag.when(lex.isin(signs), F.lit(name))
    return tag.when(lex.rlike(r"^\p{L}"), letter).otherwise(F.lit("SW"))


def script_tag(lex: Column) -> Column:
    """Tag by script where no lexicon knows the token.

    Latin letters are SL, Han SH; any other letters, Hangul among them, NA.
    """
    return F.coalesce(
        sign_tag(lex),
        F.when(lex.rlike(r"^\p{IsHan}+$"), F.lit("SH"))
        .when(lex.rlike(r"^\p{IsLatin}+$"), F.lit("SL"))
        .otherwise(F.lit("NA")),
    )


def token(lex: Column, pos: Column) -> Column:
    return F.struct(lex.alias("lex"), pos.alias("pos"))


def tag_by_script(text: Column | str) -> Column:
    """Default tokenizer: tagged tokens without a lexicon."""
    return F.transform(lexemes(text), lambda x: token(x, script_tag(x)))


def open_tag(lex: Column) -> Column:
    """Tag of signs and digits; letter runs stay open (NA)."""
    return F.coalesce(sign_tag(lex), F.lit("NA"))


def tag_unknown(text: Column | str) -> Column:
    """Tokenizer that leaves every letter run to be looked up later (NA)."""
    return F.transform(lexemes(text), lambda x: token(x, open_tag(x)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens joined by a blank.

    Shifted copies are zipped, so `tokens` is not evaluated per element.
    """
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        after = F.slice(tokens, F.lit(shift + 1), count)
        out = F.zip_with(out, after, lambda a, b: F.concat_ws(" ", a, b))
    return out
