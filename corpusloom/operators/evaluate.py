"""Evaluation statistics: perplexity, style comparison, classifier report, blind pairs.

Resamples draw by a hash of (seed, replicate, draw), so results do not depend on the engine's random numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import hashed_numbers
from corpusloom.functions.stats import normal_tail, relative_difference, wilson
from corpusloom.functions.style import METRICS
from corpusloom.functions.text import WORD, all_runs, cut_at_sentence, word_grams
from corpusloom.operators.corpus import ranked, seeded
from corpusloom.session import cut, ship


#: Rows of a model that are sent to every task: the most frequent tokens, which make up most of any text.
HEAD = 1 << 17


def _tokens(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    return docs.select(*columns, F.explode(all_runs(text)).alias("token"))


def unigram_model(docs: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """(by, token, f): how often the table, or each group `by`, has each token. Counts are partial aggregates."""
    return _tokens(docs, text, *(by or [])).groupBy(*(by or []), "token").agg(F.count(F.lit(1)).alias("f"))


def unigram_nll(docs: DataFrame, ident: str, text: str, by: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """(by, id, nll_sum, n_tokens) under an add-one unigram model of the table itself, or of each group `by`; with `of`,
    for these rows only.

    A local substitute for a language model's scores; `score` takes any other. Tokens that are frequent, at most `HEAD`
    rows of the model, are scored where the text is read and leave a row a document; only the others meet the model in a
    shuffle. No document or vocabulary is gathered.
    """
    by = by or []
    model = cut(unigram_model(docs, text, by))
    totals = model.groupBy(*by).agg((F.sum("f") + F.count(F.lit(1))).alias("t"))
    model = model.join(totals, by) if by else model.crossJoin(F.broadcast(totals))  # one row
    cost = model.select(*by, "token", "f", (-F.log((F.col("f") + 1) / F.col("t"))).alias("x"))
    step, least, rows = F.floor(4 * F.log2("f")), None, 0
    for r in sorted(cost.groupBy(step.alias("s")).count().collect(), reverse=True):  # a few steps an octave
        rows += r["count"]
        if rows > HEAD:
            break
        least = r.s
    frequent = step >= F.lit(least) if least is not None else F.lit(False)
    tokens, sums = _tokens(docs if of is None else of, text, *by, ident), [F.sum("x").alias("x"), F.count(F.lit(1)).alias("c")]
    head = F.broadcast(cost.filter(frequent).drop("f"))
    known = tokens.join(head, [*by, "token"]).groupBy(*by, ident).agg(*sums)
    rare = tokens.join(head, [*by, "token"], "left_anti").join(cost.filter(~frequent), [*by, "token"]).select(*by, ident, "x", F.lit(1).cast("long").alias("c"))
    return known.unionByName(rare).groupBy(*by, ident).agg(F.sum("x").alias("nll_sum"), F.sum("c").alias("n_tokens"))


def score(docs: DataFrame, ident: str, text: str, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, nll_sum, n_tokens) by a scorer, a text column -> struct (nll_sum, n_tokens); the unigram model without one."""
    return unigram_nll(docs, ident, text) if scorer is None else docs.select(ident, scorer(F.col(text)).alias("_s")).select(ident, "_s.nll_sum", "_s.n_tokens")


def perplexity(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """exp(sum nll / sum tokens) over the rows with tokens."""
    used = scores.filter("n_tokens > 0")
    return used.groupBy(*(by or [])).agg(F.exp(F.sum("nll_sum") / F.sum("n_tokens")).alias("ppl"), F.count(F.lit(1)).alias("n"))


def unigram_perplexities(docs: DataFrame, text: str, by: str) -> DataFrame:
    """(by, n, ppl_base, ppl_tuned): perplexity of each group under the whole table's unigram model and under its own, and
    its texts with tokens. Both are sums over the groups' token counts, so no row of a document is made."""
    own = cut(unigram_model(docs, text, [by]))
    base = own.groupBy("token").agg(F.sum("f").alias("_g"))
    total = base.agg((F.sum("_g") + F.count(F.lit(1))).alias("_u"))
    totals = own.groupBy(by).agg((F.sum("f") + F.count(F.lit(1))).alias("_t"))
    rows = own.join(base, "token").join(F.broadcast(totals), by).crossJoin(F.broadcast(total))  # a row a group, one row
    ppl = lambda f, t: F.exp(F.sum(-F.col("f") * F.log((F.col(f) + 1) / F.col(t))) / F.sum("f"))
    n = docs.filter(F.col(text).rlike(f"[{WORD}]")).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(by).agg(ppl("_g", "_u").alias("ppl_base"), ppl("f", "_t").alias("ppl_tuned")).join(n, by)


def resampled(df: DataFrame, order: str, replicates: int, seed: int | str = 42) -> DataFrame:
    """(replicate, the columns of df): draws with replacement, as many as rows in each replicate.

    Rows are numbered in seeded order by hash ranges; draw d of replicate r takes the row number md5(seed, r, d) mod n, an
    equality join. The result has rows x replicates rows, which is what a bootstrap costs.
    """
    numbered = ranked(df, [], seed, order).withColumn("_i", F.col("rank") - 1)
    draws = numbered.select("_i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    at = F.conv(F.substring(seeded(seed, "replicate", "_i"), 1, 8), 16, 10).cast("long") % F.col("n")
    return draws.select("replicate", at.alias("_i")).join(numbered.drop("rank", "n"), "_i").drop("_i")


#: Parts that the replicates are dealt in, and rows whose values a task holds at once.
PARTS, SLAB = 48, 1 << 23


def resampled_sums(df: DataFrame, columns: list[str], order: str, replicates: int, seed: int | str = 42) -> DataFrame:
    """(replicate, the columns' sums over its draws), the draws those of `resampled`; missing values count as 0.

    Only the numbered values are shuffled, once for each of the parts that the replicates are dealt in: a task makes the
    draws of its replicates and looks the values up in an array, so no row of a draw exists. Tables over `SLAB` rows are
    cut into slabs, whose tasks make the draws anew, so that a task holds 8 bytes a column and row of one slab.
    """
    ship(df.sparkSession)
    numbered = ranked(df.select(order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), [], seed, order)
    at = F.col("rank") - 1
    dealt = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, replicates) - 1))).alias("_part"), F.floor(at / SLAB).cast("int").alias("_slab"), (at % SLAB).cast("int").alias("_at"), F.col("n").cast("long").alias("_n"), *columns)

    def sums(table: pa.Table) -> pa.Table:
        part, slab, n, where = table["_part"][0].as_py(), table["_slab"][0].as_py(), table["_n"][0].as_py(), table["_at"].to_numpy()
        values = []
        for c in columns:
            values.append(np.empty(len(where)))
            values[-1][where] = table[c].to_numpy()
        mine, whole = range(part, replicates, PARTS), len(where) == n
        out = np.zeros((len(columns), len(mine)))
        for k, r in enumerate(mine):
            for drawn in hashed_numbers(f"{seed}|{r}|", n):
                drawn %= n
                if not whole:
                    drawn = drawn[drawn // SLAB == slab] % SLAB
                for j, v in enumerate(values):
                    out[j, k] += v[drawn].sum()
        return pa.table({"replicate": pa.array(mine, pa.int32()), **{c: out[j] for j, c in enumerate(columns)}})

    schema = "replicate int, " + ", ".join(f"`{c}` double" for c in columns)
    made = dealt.repartition(4 * PARTS, "_part", "_slab").groupBy("_part", "_slab").applyInArrow(sums, schema)
    return made.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_perplexity(scores: DataFrame, order: str, replicates: int = 1000) -> DataFrame:
    """Median and 95 % interval of the perplexity over resamples of a test split (whose size bounds the work)."""
    sums = resampled_sums(scores.filter("n_tokens > 0"), ["nll_sum", "n_tokens"], order, replicates)
    r = sums.select(F.exp(F.col("nll_sum") / F.col("n_tokens")).alias("ppl"))
    return r.agg(*[F.percentile("ppl", q).alias(n) for n, q in (("median", 0.5), ("ci_low", 0.025), ("ci_high", 0.975))])


def style_long(df: DataFrame, sample: str) -> DataFrame:
    """(sample, metric, value), a row per text and metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return df.select(sample, F.explode(pairs).alias("x")).select(sample, "x.metric", "x.value")


def mann_whitney(long: DataFrame, sample: str, first: str) -> DataFrame:
    """(metric, n1, n2, u, p_value): two-sided, ties corrected, normal with continuity; null where all values tie.

    Ranks come from counts per distinct value and a running sum over them, so rows of one value meet in a partial
    aggregate.
    """
    c = long.groupBy("metric", "value").agg(F.sum((F.col(sample) == first).cast("long")).alias("a"), F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    mean_rank = F.sum("t").over(w) - (F.col("t") - 1) / 2.0
    r = c.withColumn("r", F.col("a") * mean_rank).groupBy("metric").agg(F.sum("a").alias("n1"), (F.sum("t") - F.sum("a")).alias("n2"), F.sum("r").alias("r1"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = (F.col("n1") + F.col("n2")).cast("double")
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5) / F.sqrt(F.col("var"))
    out = r.withColumn("u", u).withColumn("var", var)
    return out.select("metric", "n1", "n2", "u", F.when(F.col("var") > 0, F.least(F.lit(1.0), 2 * normal_tail(F.greatest(z, F.lit(0.0))))).alias("p_value"))


def compare_styles(df: DataFrame, sample: str, real: str) -> DataFrame:
    """(metric, real, generated, diff_pct, p_value): means of both samples, their difference, and the rank test."""
    long = style_long(df, sample)
    means = long.groupBy("metric").agg(F.avg(F.when(F.col(sample) == real, F.col("value"))).alias("real"), F.avg(F.when(F.col(sample) != real, F.col("value"))).alias("generated"))
    tests = mann_whitney(long, sample, real).select("metric", "p_value")
    return means.join(tests, "metric").select("metric", "real", "generated", relative_difference(F.col("real"), F.col("generated")).alias("diff_pct"), "p_value")


def bootstrap_mean_difference(df: DataFrame, sample: str, real: str, value: str, order: str, replicates: int = 1000) -> DataFrame:
    """95 % interval of |mean real - mean other| over independent resamples of both samples."""
    def means(part: DataFrame, name: str) -> DataFrame:
        told = part.select(order, value, F.col(value).isNotNull().cast("int").alias("_told"))
        return resampled_sums(told, [value, "_told"], order, replicates).select("replicate", F.try_divide(value, "_told").alias(name))

    both = means(df.filter(F.col(sample) == real), "a").join(means(df.filter(F.col(sample) != real), "b"), "replicate")
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.percentile(d, 0.025).alias("ci_low"), F.percentile(d, 0.975).alias("ci_high"))


def classification_report(predicted: DataFrame, label: str, guess: str) -> DataFrame:
    """(class, precision, recall, f1, support) from counts of (label, guess)."""
    c = predicted.groupBy(F.col(label).alias("y"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    sides = c.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("y") == F.col("g"), F.col("c")).otherwise(0).alias("hit")), F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("named"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    t = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    f1 = rate(2 * F.col("hit"), F.col("support") + F.col("named"))
    return t.select("class", rate(F.col("hit"), F.col("named")).alias("precision"), rate(F.col("hit"), F.col("support")).alias("recall"), f1.alias("f1"), "support")


def accuracy(predicted: DataFrame, label: str, guess: str) -> DataFrame:
    """(n, correct, accuracy, ci_low_95, ci_high_95)"""
    a = predicted.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == F.col(guess)).cast("long")).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return a.select("n", "correct", (F.col("correct") / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"), low.alias("ci_low_95"), high.alias("ci_high_95"))


def train_classifier(train: DataFrame, test: DataFrame, text: str, label: str, features: int = 1 << 16) -> DataFrame:
    """test with `prediction`: TF-IDF and logistic regression on word tokens."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    token = lambda d: d.withColumn("_tokens", all_runs(F.coalesce(F.col(text), F.lit("")))).withColumn("_label", F.col(label).cast("double"))
    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(token(train))
    return model.transform(token(test)).withColumn("prediction", F.col("prediction").cast("int")).drop("_tokens", "_label", "_tf", "_x", "rawPrediction", "probability")


def blind_pairs(real: DataFrame, prompts: DataFrame, generate: Callable[[Column, Column], Column], per_register: int = 10, seed: int | str = 42, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, key): real texts and generated ones side by side, in an order the key alone tells.

    Samples of both are joined by their rank in their register; generate(register, prompt) makes the other text.
    """
    w = Window.partitionBy("register").orderBy("_h")
    r = real.select("register", F.col(text).alias("real"), seeded(seed, F.lit("real"), ident).alias("_h")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_register)
    p = prompts.select("register", "prompt", seeded(seed, F.lit("prompt"), "register", "pos").alias("_h")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_register)
    z = r.drop("_h").join(p.drop("_h"), ["register", "k"])
    number = F.row_number().over(Window.orderBy("register", "k")) - 1  # at most per_register rows a register
    z = z.withColumn("id", F.format_string("%s_%03d", "register", number)).withColumn("first", F.conv(F.substring(seeded(seed, F.lit("coin"), "id"), 1, 8), 16, 10).cast("long") % 2 == 0)
    a, b = cut_at_sentence("real"), cut_at_sentence(generate(F.col("register"), F.col("prompt")))
    pairs = z.select("id", "register", F.when(F.col("first"), a).otherwise(b).alias("text_a"), F.when(F.col("first"), b).otherwise(a).alias("text_b"), seeded(seed, F.lit("shuffle"), "id").alias("shuffle_rank"))
    key = z.select("id", "register", F.when(F.col("first"), "a").otherwise("b").alias("real_position"), F.col("prompt").alias("prompt_used"), seeded(seed, F.lit("shuffle"), "id").alias("shuffle_rank"))
    return pairs, key


def leakage(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", width: int = 8) -> DataFrame:
    """(doc, item, shared): word n-grams that documents share with benchmark items.

    n-grams meet by two 64-bit hashes, which is all of them that is exploded and shuffled.
    """
    def grams(d: DataFrame, ident: str) -> DataFrame:
        pairs = F.transform(word_grams(text, width), lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(5), g).alias("b")))
        return d.select(ident, F.explode(pairs).alias("g")).select(ident, "g.a", "g.b")

    return grams(docs, doc).join(grams(items, item), ["a", "b"]).groupBy(doc, item).agg(F.count(F.lit(1)).alias("shared"))


def covered(docs: DataFrame, prompts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos): prompts of the document's register whose distinct word runs are all in the document.

    Documents meet prompts by (register, word), and a prompt is covered if as many words meet as it has; only prompts
    without words meet every document of their register.
    """
    p = prompts.select("register", "pos", F.array_distinct(all_runs("prompt")).alias("p")).withColumn("k", F.size("p"))
    words = docs.select("register", ident, F.explode(F.array_distinct(all_runs(text))).alias("w"))
    met = words.join(p.select("register", "pos", "k", F.explode("p").alias("w")), ["register", "w"]).groupBy(ident, "pos", "k").agg(F.count(F.lit(1)).alias("n"))
    blank = docs.select("register", ident).join(p.filter("k = 0").select("register", "pos"), "register").select(ident, "pos")
    return met.filter("n = k").select(ident, "pos").union(blank)
