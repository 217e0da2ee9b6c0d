"""Text column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern (letters with at most one inner apostrophe part).
WORD_PATTERN = r"\b[a-zA-Z]+(?:'[a-zA-Z]+)?\b"
# Word pattern of word clouds (any script, apostrophes inside).
CLOUD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"

# The common English stop-word list of classic text toolkits.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your
    yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after
    above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't
    didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
    ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)


def words(text: str | Column) -> Column:
    """The lower-cased words of a text, in order, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def cloud_words(text: str | Column) -> Column:
    """Lower-cased words in any script, a possessive ``'s`` removed, as an array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(CLOUD_PATTERN), F.lit(0))
    return F.transform(found, lambda word: F.regexp_replace(word, "'s$", ""))


def is_ascii(text: str | Column) -> Column:
    """Whether a text holds ASCII characters only (an empty text does)."""
    text = F.col(text) if isinstance(text, str) else text
    return ~text.rlike(r"[^\x00-\x7F]")


def split_parts(text: str | Column, separator: str, count: int, trim: bool = False) -> list[Column]:
    """The first ``count`` parts of a delimited text, NULL where there are fewer.

    The separator is literal. Parts beyond ``count`` are dropped, so the result
    never depends on the widest row.
    """
    parts = F.split(text, re.escape(separator), count + 1)
    columns = [F.get(parts, F.lit(i)) for i in range(count)]
    return [F.trim(c) for c in columns] if trim else columns


def quoted_tokens(text: str | Column, count: int) -> list[Column]:
    """The first ``count`` double-quoted tokens of a text, backslashes removed."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"\\", ""), F.lit(r'"(.*?)"'), F.lit(1))
    return [F.get(found, F.lit(i)) for i in range(count)]
