"""Expressions over tagged tokens, `array<struct<lex, pos>>`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import UNKNOWN_TAGS, token

# Verb tags, and the ending that makes a stem a headword.
VERB_TAGS = ["VV", "VA"]
ENDING = "다"
# Tags of signs.
SIGN_TAG_LIST = ["SF", "SE", "SS", "SP", "SO", "SW"]
# Tags kept as they are when documents are lemmatised.
LEMMA_TAGS = ["NNG", "NNP", "NP", "MM", "MAG", "MAJ", "VV", "VA", "SL"]
# Fixed value: the stand-in for a token without a known tag.
NULL_TERM = "NULL"


def from_pairs(ma: Column | str) -> Column:
    """`[[lex, pos], ...]` as read from JSON, turned into structs."""
    return F.transform(ma, lambda p: token(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def to_pairs(tokens: Column | str) -> Column:
    return F.transform(tokens, lambda t: F.array(t.lex, t.pos))


def normal_lex(lex: Column, pos: Column, squeeze: bool, lemma: bool) -> Column:
    out = F.replace(lex, F.lit(" "), F.lit("")) if squeeze else lex
    if lemma:
        out = F.when(pos.isin(VERB_TAGS), F.concat(out, F.lit(ENDING))).otherwise(out)
    return out


def normalise(lex: Column, pos: Column, choose_pos: Sequence[str] | None = None,
              min_length: int = 1, lemma: bool = True) -> Column:
    """One token through the chain; NULL if it is dropped.

    Order: tag filter and removal of inner blanks, headword ending for verbs,
    length filter, NULL term for unknown tokens. The given length is used as
    is; it applies after the ending is added.
    """
    out = normal_lex(lex, pos, squeeze=bool(choose_pos), lemma=lemma)
    keep = F.length(out) >= F.lit(min_length) if min_length >= 2 else F.lit(True)
    if choose_pos:
        keep = pos.isin(list(choose_pos)) & keep
    out = F.when(pos.isin(UNKNOWN_TAGS), F.lit(NULL_TERM)).otherwise(out)
    return F.when(keep, token(out, pos))


def filter_tokens(tokens: Column | str, choose_pos: Sequence[str] | None = None,
                  min_length: int = 1, lemma: bool = True) -> Column:
    """The chain of `normalise` over a document."""
    kept = F.transform(tokens, lambda t: normalise(t.lex, t.pos, choose_pos, min_length, lemma))
    return F.filter(kept, lambda t: t.isNotNull())


def deny_tokens(tokens: Column | str, tags: Sequence[str] = tuple(SIGN_TAG_LIST)) -> Column:
    """Drop the tokens with one of `tags`."""
    return F.filter(tokens, lambda t: ~t.pos.isin(list(tags)))


def lemma_of(lex: Column, pos: Column, tags: Sequence[str] = tuple(LEMMA_TAGS)) -> Column:
    """Headword of a verb, other listed tokens as they are, NULL otherwise."""
    return (F.when(pos.isin(VERB_TAGS), F.concat(lex, F.lit(ENDING)))
            .when(pos.isin(list(tags)), lex))


def lemma_tokens(tokens: Column | str, tags: Sequence[str] = tuple(LEMMA_TAGS)) -> Column:
    lemmas = F.transform(tokens, lambda t: lemma_of(t.lex, t.pos, tags))
    return F.filter(lemmas, lambda x: x.isNotNull() & (x != ""))


def lex_only(tokens: Column | str) -> Column:
    return F.transform(tokens, lambda t: t.lex)


def term(lex: Column | str, pos: Column | str) -> Column:
    """`lex/pos`."""
    return F.concat_ws("/", lex, pos)


def terms(tokens: Column | str) -> Column:
    return F.transform(tokens, lambda t: term(t.lex, t.pos))


def term_lex(col: Column | str) -> Column:
    """The part of `lex/pos` before the first slash."""
    return F.substring_index(col, "/", 1)


def exact_hits(tokens: Column | str, query: Sequence[str]) -> Column:
    """True if as many tokens are query words as the query has words.

    A repeated word can stand for a missing one; see `contains_all`.
    """
    asked = list(query)
    return F.size(F.filter(tokens, lambda t: t.isin(asked))) == F.lit(len(asked))


def contains_all(tokens: Column | str, query: Sequence[str]) -> Column:
    """True if every query word occurs."""
    asked = F.array(*[F.lit(q) for q in query])
    return F.size(F.array_except(asked, tokens)) == F.lit(0)
