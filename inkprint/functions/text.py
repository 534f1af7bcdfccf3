"""Text predicates and scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as white space when splitting or stripping text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: the same set as a regular-expression class body.
WHITESPACE_CLASS = r"\t-\r\x1c-\x1f \x85\p{Z}"

MIN_ALPHA_FRACTION = 0.75
MIN_POST_LENGTH = 1


def alpha_fraction(text: Column) -> Column:
    """Share of Unicode letters among all characters; null for empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return letters / F.nullif(F.length(text), F.lit(0))


def keep_post(text: Column, min_fraction: float = MIN_ALPHA_FRACTION, min_length: int = MIN_POST_LENGTH) -> Column:
    """True for posts long enough and mostly made of letters."""
    keep = (F.length(text) >= min_length) & (alpha_fraction(text) >= min_fraction)
    return F.coalesce(keep, F.lit(False))


def clean_newlines(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def strip_trailing(text: Column) -> Column:
    """Drop white space of every kind at the end; a linear scan, unlike a regular expression."""
    return F.rtrim(text, F.lit(WHITESPACE))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITESPACE_CLASS}]+"))


def words(text: Column) -> Column:
    """White-space separated words, empty strings never included."""
    return F.regexp_extract_all(text, F.lit(f"[^{WHITESPACE_CLASS}]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Maximal runs of two or more letters, digits or underscores; case is kept."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def md5_bucket(value: Column, buckets: int) -> Column:
    """Feature hashing that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def hashed_symbols(text: Column, num_symbols: int = 65536, reserved: int = 3) -> Column:
    """One symbol id per word. Ids below `reserved` stay free for pad, end and unknown."""
    return F.transform(words(text), lambda w: (md5_bucket(w, num_symbols - reserved) + reserved).cast("int"))


# English stop words, matched exactly and in lower case.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's
ought that's there's what's when's where's who's why's would
""".split()
