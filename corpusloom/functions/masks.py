"""Masking of personal data by nine patterns in a fixed order, with clock times shielded from the phone pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANK, EDGE, WORD, col, let

#: Where a word begins with a digit or a capital: its class comes first, as it fails soonest, and the edge before a word
#: character is just that no other precedes it.
_DIGITS, _CAPITALS, _END = rf"(?=\p{{Nd}})(?<![{WORD}])", rf"(?=[A-Z])(?<![{WORD}])", rf"(?![{WORD}])"
#: What each mask stands for, in order of application up to the clock times.
URL = rf"https?://[^{BLANK}]+"
EMAIL = rf"{EDGE}[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+{EDGE}"
HANDLE = rf"@[{WORD}]{{3,}}"
COORDS = rf"-?\p{{Nd}}{{1,2}}\.\p{{Nd}}{{4,}},[{BLANK}]*-?\p{{Nd}}{{1,3}}\.\p{{Nd}}{{4,}}"
CBU = rf"{_DIGITS}\p{{Nd}}{{22}}{_END}"
IBAN = rf"{_CAPITALS}[A-Z]{{2}}\p{{Nd}}{{2}}[A-Z0-9]{{4,30}}{_END}"
HOUR = rf"(?i){_DIGITS}\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?[{BLANK}]*(?:[ap]\.?[{BLANK}]*m\.?)?{EDGE}"
PHONE = rf"(?=[+\p{{Nd}}])(?<![:\p{{Nd}}])\+?\p{{Nd}}[\p{{Nd}}{BLANK}\-().]{{6,}}\p{{Nd}}(?![:/\p{{Nd}}])"
ID = rf"{_DIGITS}\p{{Nd}}{{7,8}}{_END}"
NUM = rf"{_DIGITS}\p{{Nd}}{{9,}}{_END}"
LABELS = ("PER", "LOC", "ORG")
#: The patterns as RE2, the engine of the queries' SQL, reads them: its word edges know ASCII only. It cannot look around,
#: so that a phone number takes what may not stand beside it along, and the next one has to do without.
ASCII_WORD = "A-Za-z0-9_"
ASCII_EDGE = rf"(?:(?<=[{ASCII_WORD}])(?![{ASCII_WORD}])|(?<![{ASCII_WORD}])(?=[{ASCII_WORD}]))"
_RE2_DIGITS = rf"(?=\p{{Nd}}){ASCII_EDGE}"
RE2 = {
    EMAIL: EMAIL.replace(EDGE, ASCII_EDGE),
    CBU: rf"{_RE2_DIGITS}\p{{Nd}}{{22}}{ASCII_EDGE}",
    IBAN: rf"(?=[A-Z]){ASCII_EDGE}[A-Z]{{2}}\p{{Nd}}{{2}}[A-Z0-9]{{4,30}}{ASCII_EDGE}",
    HOUR: HOUR.replace(_DIGITS, _RE2_DIGITS).replace(EDGE, ASCII_EDGE),
    ID: rf"{_RE2_DIGITS}\p{{Nd}}{{7,8}}{ASCII_EDGE}",
    NUM: rf"{_RE2_DIGITS}\p{{Nd}}{{9,}}{ASCII_EDGE}",
}
RE2_PHONE = rf"(^|[^:\p{{Nd}}])(\+?\p{{Nd}}[\p{{Nd}}{BLANK}\-().]{{6,}}\p{{Nd}})(\z|[^:/\p{{Nd}}])"


def _mask(c: Column, pattern: str, token: str, re2: bool = False) -> Column:
    return F.regexp_replace(c, RE2.get(pattern, pattern) if re2 else pattern, f"<{token}>")


def mask_links(c: str | Column, re2: bool = False) -> Column:
    """URLs, mail addresses, handles, coordinates and account numbers; `re2` reads the patterns as the SQL does."""
    # the two patterns around an "@" are costly to refuse at every place, so texts without one skip them
    at = lambda v: F.when(F.contains(v, F.lit("@")), _mask(_mask(v, EMAIL, "EMAIL", re2), HANDLE, "HANDLE")).otherwise(v)
    out = let(_mask(col(c), URL, "URL"), at)
    for pattern, token in ((COORDS, "COORDS"), (CBU, "CBU"), (IBAN, "IBAN")):
        out = _mask(out, pattern, token, re2)
    return out


def mask_phones(c: str | Column, re2: bool = False) -> Column:
    """Phone numbers, in the pieces between clock times, which are put back between the masked pieces. With `re2`, of two
    numbers one character apart the second keeps its "+" before the mask, as in the SQL."""
    hour = RE2[HOUR] if re2 else HOUR
    taken = lambda s: F.regexp_replace(s, RE2_PHONE, "$1<PHONE>$3")
    # the pattern is costly to refuse at every place, so pieces without such a run skip it
    twice = lambda s: F.when(s.rlike(rf"\p{{Nd}}[\p{{Nd}}{BLANK}\-().]{{6,}}\p{{Nd}}"), taken(taken(s))).otherwise(s)

    def masked(v: Column) -> Column:
        pieces = F.transform(F.split(v, hour, -1), lambda s: twice(s) if re2 else _mask(s, PHONE, "PHONE"))
        times = F.concat(F.regexp_extract_all(v, F.lit(hour), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, times, lambda a, b: F.concat(a, b)), "")

    return let(col(c), masked)


def mask_numbers(c: str | Column, re2: bool = False) -> Column:
    return _mask(_mask(col(c), ID, "ID", re2), NUM, "NUM", re2)


def anonymize(c: str | Column, id_first: bool = False, re2: bool = False) -> Column:
    """All masks in order. Eight-digit ids look like phone numbers and become <PHONE>; `id_first` masks ids before."""
    out = mask_links(c, re2)
    out = _mask(out, ID, "ID", re2) if id_first else out
    return mask_numbers(mask_phones(out, re2), re2)


def anonymize_names(df: DataFrame, text: str, recognize: Callable[[Column], Column] | None, keep: tuple[str, ...] = (), keep_author: bool = True, strict: bool = False) -> DataFrame:
    """df with names in `text` masked by a recognizer: text column -> array of (start, end, label), sorted, 0-based.

    Without a recognizer the text stays as it is, or, with `strict`, an error is raised before anything runs. A span
    that holds one of the `keep` names (lower case) stays if `keep_author`.
    """
    if recognize is None:
        if strict:
            raise RuntimeError("no recognizer for names, and strict is set")
        return df
    c = F.col(text)
    spans = F.filter(recognize(c), lambda s: s["label"].isin(*LABELS))
    if keep_author and keep:
        held = F.array(*[F.lit(k) for k in keep])
        spans = F.filter(spans, lambda s: ~F.exists(held, lambda k: F.contains(F.lower(F.substring(c, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), k)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    add = lambda acc, s: F.struct(s["end"].cast("bigint").alias("at"), F.concat(acc["out"], F.substring(c, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["label"], F.lit(">")).alias("out"))
    return df.withColumn(text, F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(c, (acc["at"] + 1).cast("int"), F.length(c)))))


def gazetteer(names: dict[str, str], word: str = WORD) -> Callable[[Column], Column]:
    """A recognizer that finds listed names as whole words, of the characters `word`; names: name -> label."""
    labels = F.create_map(*[F.lit(x.lower() if i % 2 == 0 else x) for n, l in names.items() for i, x in enumerate((n, l))])
    pattern = "|".join(rf"\Q{n}\E" for n in sorted(names, key=len, reverse=True))
    regex = rf"(?iu)(?<![{word}])(?:{pattern})(?![{word}])"

    def find(c: Column) -> Column:
        pieces, hits = F.split(c, regex, -1), F.regexp_extract_all(c, F.lit(regex), F.lit(0))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))

        def add(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["p"])
            z = a + F.length(x["h"])
            return F.struct(z.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), z.alias("end"), F.element_at(labels, F.lower(x["h"])).alias("label")))).alias("spans"))

        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
        return F.aggregate(pairs, first, add, lambda acc: acc["spans"])

    return find
