"""Column functions on text: blanks, normal forms, tokens, chunks, cuts, HTML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and word characters as explicit classes: the engine's own \s, \w and \b know ASCII only.
BLANK = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, even where the body uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c: str | Column) -> Column:
    """Text without white space at its ends, of any kind."""
    return F.regexp_replace(col(c), rf"^[{BLANK}]+|[{BLANK}]+$", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"[{BLANK}]+$", "")


def words(c: str | Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(col(c), F.lit(rf"([^{BLANK}]+)"), F.lit(1))


def casefold(c: str | Column) -> Column:
    """A case-insensitive form that also joins letters whose capitals are two."""
    return F.lower(F.upper(col(c)))


def normal_form(c: str | Column) -> Column:
    """Stripped, lower case, runs of white space as one blank: the key of exact dedup."""
    return F.regexp_replace(F.lower(strip(c)), rf"[{BLANK}]+", " ")


def normal_hash(c: str | Column) -> Column:
    return F.sha1(normal_form(c))


def word_chunks(c: str | Column, size: int = 400, overlap: int = 50) -> Column:
    """Array of windows of `size` words that overlap by `overlap`; the last one reaches the end; no words, no window."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the window")
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
        made = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " "))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    return let(words(c), windows)


def word_grams(c: str | Column, width: int) -> Column:
    """Distinct runs of `width` lower-case words of word characters; null if there are fewer words."""

    def grams(runs: Column) -> Column:
        n = F.size(runs) - (width - 1)
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(runs, k, F.lit(width)), " "))))

    return let(all_runs(c), grams)


def style_tokens(c: str | Column) -> Column:
    """Lower-case runs of word characters that are longer than one."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(rf"([{WORD}]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def all_runs(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(rf"([{WORD}]+)"), F.lit(1))


def cut_at_sentence(c: str | Column, limit: int = 600) -> Column:
    """Texts over `limit` are cut after the last sentence end or blank line in their first `limit` characters."""
    c = col(c)
    head = F.substring(c, 1, limit)
    ended = F.regexp_extract(head, rf"(?s)^(.*(?:[.!?](?:[{BLANK}]|$)|\n\n))", 1)
    return F.when(F.length(c) <= limit, c).when(ended != "", strip(ended)).otherwise(rstrip(head))


def html_text(c: str | Column) -> Column:
    """Every tag becomes a blank."""
    return F.regexp_replace(col(c), "<[^>]+>", " ")


def append_once(c: str | Column, end: str) -> Column:
    """Text that ends with `end`, appended only where it is missing."""
    c = col(c)
    return F.when(F.lit(end == "") | c.endswith(end), c).otherwise(F.concat(c, F.lit(end)))


def chat_template(prompt: str | Column, answer: str | Column, begin: str = "<start_of_turn>", stop: str = "<end_of_turn>") -> Column:
    """A user and a model turn as one training text."""
    turn = lambda who, c: F.concat(F.lit(f"{begin}{who}\n"), col(c), F.lit(f"{stop}\n"))
    return F.concat(turn("user", prompt), turn("model", answer))


def after_echo(generated: str | Column, prompt: str | Column) -> Column:
    """What a model added after the prompt that it repeats, without tags, stripped."""
    g, p = col(generated), col(prompt)
    at = F.instr(g, p)
    rest = F.when((at > 0) & (F.length(p) > 0), F.substring(g, at + F.length(p), F.length(g))).otherwise(g)
    return strip(F.regexp_replace(rest, "<[^>]*>", ""))


def contains_any(c: str | Column, needles: list[str]) -> Column:
    """True if the lower-case text holds any of the (lower-case) needles."""
    low = F.lower(col(c))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in needles], F.lit(False))


def until_match(lines: Column, pattern: str) -> Column:
    """The lines before the first one whose stripped form matches at its start."""

    def cut(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda s: strip(s).rlike(pattern)), F.lit(True))
        return F.when(at > 0, F.slice(ls, F.lit(1), (at - 1).cast("int"))).otherwise(ls)

    return let(lines, cut)
