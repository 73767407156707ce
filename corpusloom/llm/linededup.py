"""Line dedup by overlapping three-line windows, with DataFrame functions only.

The non-blank lines of a text, trimmed, form windows of three consecutive lines. A long passage may have fewer: one line
of LONG words or more (blanks plus one), or two that have as many together, is a window, too. A window (two 64-bit
hashes of its lines' hashes) found more than once in the corpus is kept where it stands first, in the order of (doc_id,
text hash, position); every later occurrence covers its lines, and the lines that any later occurrence covers are
removed. Whatever is removed stands unbroken at an earlier place, so by induction no line's last copy is lost.

Scale: lines are hashed once; windows shuffle as (hash, place) with partial aggregation, never as text; only repeated
windows join back, on a hash of which adaptive execution splits the hot values; covered positions meet once per
document, bounded by its lines. The texts are shuffled once, to meet their covered positions.

Edge cases: null and empty texts stay as they are, with 0 lines; a text with fewer than three non-blank lines has only
the windows of long passages; a line may end in \r\n; blank lines between covered ones stay; rows with the same doc_id
and text are one document and all get its result, rows with the same doc_id but other texts are ordered by text hash; a
null doc_id ranks last; other columns are kept, but for one named `line_dedup`, which the result replaces; an empty
table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.columns import packed, unpacked
from corpusloom.session import cut

LINES = 3
LONG = 50
LAST = 9223372036854775807


def _clean(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def _places(raw: Column) -> Column:
    """Indexes of the lines that are not blank."""
    return F.filter(F.transform(raw, lambda s, i: F.when(_clean(s) != "", i)), lambda i: i.isNotNull())


def _windows(lines: Column, size: int, long: int) -> Column:
    """(p, k, a, b) of the windows of an array of lines: first line (from 1), number of lines, hashes."""
    words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    hashed = F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(7), s).alias("b"), words(s).alias("w")))

    def made(ls: Column) -> Column:
        n = F.size(ls)
        at = lambda p, f: F.element_at(ls, p)[f]
        span = lambda p, k: F.struct(p.alias("p"), F.lit(k).alias("k"), *[F.xxhash64(F.lit(k), *[at(p + j, f) for j in range(k)]).alias(f) for f in ("a", "b")])
        places = lambda k: F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        whole = F.transform(places(size), lambda p: span(p, size))
        one = F.transform(F.filter(places(1), lambda p: at(p, "w") >= long), lambda p: span(p, 1))
        two = F.transform(F.filter(places(2), lambda p: (at(p, "w") < long) & (at(p + 1, "w") < long) & (at(p, "w") + at(p + 1, "w") >= long)), lambda p: span(p, 2))
        return F.concat(whole, one, two)

    return let(hashed, made)


def dedup_lines(docs: DataFrame, text: str = "text", lines: int = LINES, split_at: str = "\n", long: int = LONG) -> DataFrame:
    """docs with a struct column `line_dedup` (text, n_lines, n_removed); the column `text` itself is left alone."""
    order = F.coalesce(F.col("doc_id"), F.lit(LAST))
    full = F.filter(F.transform(F.split(text, split_at, -1), _clean), lambda s: s != "")
    base = docs.select(order.alias("_d"), F.xxhash64(text).alias("_h"), _windows(full, lines, long).alias("_w"))
    windows = cut(base.select("_d", "_h", F.explode("_w").alias("s")).select("_d", "_h", "s.*"))
    place = F.struct("_d", "_h", "p")
    again = cut(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("a", "b", "first"))
    later = windows.join(again, ["a", "b"]).filter(place > F.col("first"))
    covered = cut(later.groupBy("_d", "_h").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("p"), F.col("p") + F.col("k") - 1)))).alias("_p")))
    rows = docs.select(packed(docs), order.alias("_d"), F.xxhash64(text).alias("_h"))
    out = rows.join(covered, ["_d", "_h"], "left").select("row", "_p", F.split(F.col("row")[text], split_at, -1).alias("raw"))
    out = out.select("row", "_p", "raw", F.when(F.col("_p").isNull(), F.size(F.filter("raw", lambda s: _clean(s) != ""))).otherwise(F.size(_places(F.col("raw")))).alias("n"))

    def rebuilt(places: Column) -> Column:
        gone = F.transform("_p", lambda k: F.element_at(places, k))
        left = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.element_at(F.col("raw"), i + 1)), "\n")

    made = out.select(
        "row",
        F.struct(
            F.when(F.col("_p").isNull(), F.col("row")[text]).otherwise(let(_places(F.col("raw")), rebuilt)).alias("text"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col("_p").isNull(), 0).otherwise(F.size("_p")).cast("long").alias("n_removed"),
        ).alias("line_dedup"),
    )
    return made.select(*unpacked(docs, "line_dedup"), "line_dedup")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.text")


_BLANKS = "E'\\t\\r\\x0b\\x0c'"
SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, E'\\n') AS raw FROM documents),
d1 AS (SELECT *, list_transform(raw, lambda s: trim(translate(s, {_BLANKS}, '    '), ' ')) AS clean FROM d),
l AS (SELECT *, list_filter(range(1, len(raw) + 1), lambda i: clean[i] <> '') AS places, list_filter(clean, lambda s: s <> '') AS ls FROM d1),
s AS (SELECT doc_id, ls, list_transform(ls, lambda s: length(s) - length(replace(s, ' ', '')) + 1) AS ws FROM l),
w AS (SELECT doc_id, p, {LINES} AS k, array_to_string(ls[p:p + {LINES - 1}], E'\\n') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - {LINES - 2})) AS p FROM s WHERE len(ls) >= {LINES})
      UNION ALL SELECT doc_id, p, 1, ls[p] FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM s) WHERE ws[p] >= {LONG}
      UNION ALL SELECT doc_id, p, 2, ls[p] || E'\\n' || ls[p + 1] FROM (SELECT *, unnest(range(1, len(ls))) AS p FROM s) WHERE ws[p] < {LONG} AND ws[p + 1] < {LONG} AND ws[p] + ws[p + 1] >= {LONG}),
x AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS rn FROM w),
c AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + k)))) AS nums FROM x WHERE rn > 1 GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(places), 0)::BIGINT AS n_lines, coalesce(len(nums), 0)::BIGINT AS n_removed,
       CASE WHEN nums IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(list_transform(nums, lambda n: places[n]), i)), lambda i: raw[i]), E'\\n') END AS text
FROM l LEFT JOIN c ON l.doc_id = c.doc_id
"""
