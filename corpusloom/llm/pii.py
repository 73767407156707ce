"""Personal data: spans of four base kinds, and terms that reveal them, by corpus co-occurrence; DataFrame functions only.

Base kinds (email, ip, card, phone) are found by patterns and checks. Each base value is a protected entity. The words
of the texts that hold it are terms, however far off; with n(e), n(t) and n(e, t) the distinct texts that hold the
entity, the term and both, and N distinct texts, a term's disclosure of e is PMI / IC = log(n(e,t) N / n(e) n(t)) /
log(N / n(e)), at most 1: the share of the entity's information that the term gives away. A term that discloses some
entity by `disclosure` or more, with at least `support` texts and P(e | t) of `odds` or more, is sanitised wherever it
stands: generalised to a placeholder, or removed if it gives away `remove` or more.

Equal texts count once, so copies of one document do not make its words revealing; a passage that different texts share
counts once in each of them.

Scale: patterns run in one pass; entities, pairs and words meet in partial aggregates. Entities in fewer than `support`
texts pair with nothing, nor do terms in too few texts, or in more than the odds allow for the text's most frequent
entity. Candidate terms are broadcast only if there are at most BROADCAST_TERMS of them; beyond that (id, term) is
shuffled to them. Texts are shuffled once, by id, to meet the terms that they hold; they are never repeated per word.
Work on one text is linear in its length and, up to millions, in the number of its spans.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive; base spans of one kind never
overlap, those of different kinds may; a term never overlaps a base span (of these only addresses hold letters); equal
texts get equal spans; other columns are kept, but for one named `pii`, which the result replaces; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.columns import packed, unpacked
from corpusloom.session import cut

# Runs that cannot start earlier are entered only at their start (or where the last match ended), and repeats never give
# back, so that long runs cost linear time and no stack; the matches are those of the plain patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
KINDS = ("email", "ip", "card", "phone")
TERM = r"(?<![\p{L}\p{M}\p{N}'])\p{L}[\p{L}\p{M}']*+(?!\p{N})"
SUPPORT, DISCLOSURE, ODDS, REMOVE = 3, 0.9, 0.6, 0.999
BROADCAST_TERMS = 100_000
STEP = 1024
PIECE = 512
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def located(text: Column, pattern: Column | str) -> Column:
    """(start, end, value) of all matches, from the pieces between them: their lengths add up to the offsets."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, hits = F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["piece"])
        z = a + F.length(x["hit"])
        return F.struct(z.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), z.alias("end"), x["hit"].alias("value")))).alias("spans"))

    def parts(pairs: Column) -> Column:
        # Arrays grow by copying: spans are gathered in runs of STEP, so that many matches do not cost their square.
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STEP).cast("int")), lambda k: F.slice(pairs, k * STEP + 1, F.lit(STEP)))
        whole = lambda acc, part: F.struct(part["at"].alias("at"), F.concat(acc["spans"], part["spans"]).alias("spans"))
        return F.aggregate(runs, start, lambda acc, run: let(F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("spans")), add), lambda part: whole(acc, part)), lambda acc: acc["spans"])

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return let(zipped, lambda pairs: F.when(F.size(pairs) > 0, parts(pairs)).otherwise(F.array().cast(_SPANS)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind; the cheap conditions before the patterns spare texts that cannot match."""
    none = F.array().cast(_SPANS)
    found = lambda may, pattern, good: F.when(may, F.filter(located(text, pattern), lambda s: good(s["value"]))).otherwise(none)
    size = lambda v: F.length(_digits(v))
    digit = text.rlike("[0-9]")
    return {
        "email": found(F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        "ip": found(digit, IP, lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        "card": found(digit, CARD, lambda v: luhn(_digits(v))),
        "phone": found(F.contains(text, F.lit("+")), PHONE, lambda v: size(v).between(8, 15)),
    }


def _entity(kind: str, value: Column) -> Column:
    bare = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), bare)


def _terms(s: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(TERM), F.lit(0)), F.lower))


def _outside(text: Column) -> Column:
    """The text with blanks in place of its mail addresses, the only base spans that hold letters."""
    blank = F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda p, h: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(h)), F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(blank, "")).otherwise(text)


def _read(texts: DataFrame) -> DataFrame:
    """(id, entities, terms) of the texts that hold an entity, worked out in one pass; equal texts once."""
    mentioned = lambda kind: F.transform(kind, lambda s: _entity(kind, s["value"]))
    entities = F.array_distinct(F.concat(*[mentioned(k) for k in KINDS]))
    terms = F.when(F.size(F.concat(*KINDS)) > 0, _terms(_outside(F.col("text"))))
    # filtered only after the cut: a filter before it would find the spans twice
    return cut(texts.select("id", entities.alias("entities"), terms.alias("terms"))).filter(F.size("entities") > 0)


def revealing_terms(texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, odds: float = ODDS) -> DataFrame | None:
    """(term, disclosure) of the terms over the thresholds, from `texts` (id, text, spans by kind), where equal texts
    share an id and count once; None if no pair of entity and term has the support."""
    read = _read(texts)
    mentions = cut(read.select("id", F.explode("entities").alias("entity")).distinct())
    entities = cut(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support))
    named = cut(mentions.join(entities, "entity"))
    # n(t) is at least the number of texts with an entity that have the term, so a pair that misses the odds by that
    # number misses them by n(t) too: common words go before pairs are made and the whole corpus is searched
    most = named.groupBy("id").agg(F.max("n_e").alias("most"))
    known = read.select("id", F.explode("terms").alias("term"))
    words = cut(known.join(most, "id").distinct())
    near = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"), F.max("most").alias("top")).filter((F.col("n_near") >= support) & (F.col("top") >= odds * F.col("n_near")))
    pairs = words.join(near, "term").join(named, "id").filter(F.col("n_e") >= odds * F.col("n_near"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_near").alias("n_near"))
    pairs = cut(pairs.filter((F.col("n_et") >= support) & (F.col("n_et") >= odds * F.col("n_near"))).drop("n_near"))
    candidates = pairs.select("term").distinct()
    n = candidates.count()
    if not n:
        return None
    candidates = F.broadcast(candidates) if n <= BROADCAST_TERMS else candidates
    # the words of texts with entities are known; those of the others are searched
    plain = texts.select("id", F.explode(_terms(F.col("text"))).alias("term")).join(candidates, "term").join(mentions.select("id").distinct(), "id", "left_anti")
    held = plain.select("id", "term").union(known.join(candidates, "term").select("id", "term")).groupBy("term").agg(F.countDistinct("id").alias("n_t"))
    total = float(texts.select("id").distinct().count())
    share = F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))
    told = F.log(share * total / F.col("n_e")) / F.log(F.greatest(F.lit(total) / F.col("n_e"), F.lit(1.000001)))
    scored = pairs.join(held, "term").join(entities, "entity").select("term", told.alias("told"), share.alias("share"))
    return cut(scored.filter((F.col("told") >= disclosure) & (F.col("share") >= odds)).groupBy("term").agg(F.max("told").alias("disclosure")))


def _held_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, held): the terms, with their disclosure, of each text that has any."""
    hot = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    words = texts.select("id", F.explode(_terms(_outside(F.col("text")))).alias("term")).join(hot, "term")
    return words.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("held"))


def _term_spans(text: Column, held: Column) -> Column:
    """Where the terms stand in a text: its words are found once and looked up."""
    words = F.filter(located(_outside(text), TERM), lambda s: F.map_contains_key(held, F.lower(s["value"])))
    return F.transform(words, lambda s: F.struct(s["start"], s["end"], s["value"], F.element_at(held, F.lower(s["value"])).alias("disclosure")))


def _rewritten(text: Column, remove: float) -> Column:
    """The text with every span replaced by its placeholder, or by nothing for terms that give away almost all.

    The text is cut into pieces of PIECE characters once; what stands between two spans is taken from its pieces only.
    """
    token = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove, "").otherwise("<TERM>").alias("by")))
    spans = F.array_sort(F.concat(*[token(k) for k in KINDS], terms))
    empty = F.array().cast("array<string>")

    def made(pieces: Column, ordered: Column) -> Column:
        def between(a: Column, z: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
            own = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(z > a, F.substring(own, (a - first * PIECE + 1).cast("int"), (z - a).cast("int"))).otherwise("")

        def add(acc: Column, s: Column) -> Column:
            moved = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(between(acc["at"], s["start"]), s["by"])).alias("out"))
            return F.when(s["start"] >= acc["at"], moved).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

        # as in `located`, arrays grow run by run
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / STEP).cast("int")), lambda k: F.slice(ordered, k * STEP + 1, F.lit(STEP)))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
        inner = lambda acc, run: F.aggregate(run, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        whole = lambda acc, run: let(inner(acc, run), lambda part: F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out")))
        end = F.length(text).cast("bigint")
        return F.aggregate(runs, start, whole, lambda acc: F.array_join(F.concat(acc["out"], F.array(between(acc["at"], end))), ""))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    both = let(F.struct(pieces.alias("p"), spans.alias("s")), lambda v: made(v["p"], v["s"]))
    return F.when(sum((F.size(c) for c in (*KINDS, "terms")), F.lit(0)) > 0, both).otherwise(text)


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, odds: float = ODDS, remove: float = REMOVE) -> DataFrame:
    """docs with a struct `pii`: spans (start, end, value) by kind, terms (with their disclosure), and the sanitised text."""
    rows = docs.select(packed(docs), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ident = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(5), "text").alias("b")).alias("id")
    rows = rows.select("row", "text", ident, *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    terms = revealing_terms(rows, support, disclosure, odds)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,disclosure:double>>")
    if terms is None:
        out = rows.withColumn("terms", none)
    else:
        out = rows.join(cut(_held_terms(rows, terms)), "id", "left").withColumn("terms", F.when(F.col("held").isNull(), none).otherwise(_term_spans(F.col("text"), F.col("held"))))
    result = F.struct(*KINDS, "terms", _rewritten(F.col("text"), remove).alias("text"))
    return out.select("row", result.alias("pii")).select(*unpacked(docs, "pii"), "pii")


def _listed(kinds: tuple[str, ...], pii: str = "pii") -> Column:
    """kind:start:end of all spans of the kinds, in their order, then by start, comma-joined."""
    names = {k: k if k in KINDS else "term" for k in kinds}
    at = lambda k: F.transform(F.col(f"{pii}.{'terms' if names[k] == 'term' else k}"), lambda s: F.concat_ws(":", F.lit(names[k]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[at(k) for k in kinds]), ",")


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sanitise(docs)
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "terms")).alias("spans"))
