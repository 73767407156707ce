"""Style metrics of a text: five numbers, 0 for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANK, all_runs, col, style_tokens, words

#: Regional words, interjections, and the code points that count as emoji.
REGIONAL = ["boludo", "che", "posta", "dale", "copado", "quilombo", "laburo", "laburar", "loco", "banda", "chabón", "pibe", "fiaca", "bardear", "morfar", "chamuyo", "trucho", "zarpado", "groso", "onda", "joya", "plata", "guita"]
INTERJECTIONS = ["jaja", "jeje", "jsjs", "ajá", "bah", "uy", "ay", "eh", "mm", "uff", "jua", "xd", "lol"]
EMOJI = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF), (0x2702, 0x27B0), (0x24C2, 0x1F251)]
EMOJI_RUN = "[" + "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in EMOJI) + "]+"
METRICS = ("ttr", "avg_sentence_length", "regional_rate", "emoji_density", "interjection_rate")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def type_token_ratio(c: str | Column) -> Column:
    t = style_tokens(c)
    return _ratio(F.size(F.array_distinct(t)), F.size(t))


def sentence_length(c: str | Column) -> Column:
    """Mean number of words of the sentences."""
    parts = F.filter(F.split(col(c), "[.!?]+", -1), lambda s: F.regexp_count(s, F.lit(rf"[^{BLANK}]")) > 0)
    counts = F.transform(parts, lambda s: F.size(words(s)))
    return _ratio(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.size(parts))


def lexicon_rate(c: str | Column, lexicon: list[str]) -> Column:
    """Whole words of the lexicon per hundred words: maximal word runs equal to an entry."""
    hits = F.filter(all_runs(c), lambda t: t.isin(*lexicon))
    return _ratio(F.size(hits) * 100, F.size(words(c)))


def emoji_density(c: str | Column) -> Column:
    """Runs of emoji per hundred characters."""
    return _ratio(F.regexp_count(col(c), F.lit(EMOJI_RUN)) * 100, F.length(col(c)))


def style_vector(c: str | Column) -> list[Column]:
    made = (type_token_ratio(c), sentence_length(c), lexicon_rate(c, REGIONAL), emoji_density(c), lexicon_rate(c, INTERJECTIONS))
    return [m.alias(n) for m, n in zip(made, METRICS, strict=True)]
