"""Text normalisers, tokenisers and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as one regex class, valid for java.util.regex and RE2 alike.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]{2,}"


# The same characters as a list, for the cheaper trim.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def clean(c: Column) -> Column:
    """Collapse every run of white space to one blank and strip; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def null_if_blank(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def match_key(c: Column) -> Column:
    """Lower-case text where each run of other characters than a-z and 0-9 is one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(key: Column) -> Column:
    """Distinct blank-separated tokens of an already normalised key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def word_count(c: Column) -> Column:
    cleaned = clean(c)
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " ")))


def join_nonblank(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def labelled(label: str, text: Column) -> Column:
    """``label + text`` where text is not blank, else null (so concat_ws leaves it out)."""
    return F.when(text != "", F.concat(F.lit(label), text))


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Substring test against a fixed phrase list of letters, digits and blanks."""
    needed = [p for p in phrases if not any(q != p and q in p for q in phrases)]
    return c.rlike("|".join(needed)) if needed else F.lit(False)


def word_ngrams(c: Column, stop_words: Sequence[str] = (), max_n: int = 2) -> Column:
    """Array of word 1..max_n-grams of the lower-cased text, stop words removed first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    if stop_words:
        listed = string_array(sorted(stop_words))
        words = F.filter(words, lambda w: ~F.array_contains(listed, w))
    if max_n == 1:
        return words
    if max_n != 2:
        raise ValueError("word n-grams are built for n = 1 or 1..2")

    def with_pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))

    # A one-element array names the words, so that the text is read once.
    return F.flatten(F.transform(F.array(words), with_pairs))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words."""
    lowered = clean(F.lower(F.coalesce(c, F.lit(""))))
    padded = F.transform(
        F.filter(F.split(lowered, " "), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )
    def of_length(n: int) -> Column:
        def cut(w: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n))
            )

        return F.flatten(F.transform(F.filter(padded, lambda w: F.length(w) >= n), cut))

    return F.concat(*[of_length(n) for n in range(low, high + 1)])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's tokens that occur in b; 0 where a is empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; two empty sets give 0.5."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.5)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))
    )
