"""Evaluation metrics as aggregations: every one is sums over rows, so partial results combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ngrams
from .relational import running


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings."""
    kinds = F.array_intersect(a, b)
    return F.aggregate(kinds, F.lit(0), lambda n, k: n + F.least(F.size(F.filter(a, lambda x: x == k)), F.size(F.filter(b, lambda x: x == k))))


def f1(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Harmonic mean of precision and recall; of two empty sides 1, of one 0."""
    return F.when((n_a == 0) | (n_b == 0), (n_a == n_b).cast("double")).when(overlap == 0, F.lit(0.0)).otherwise(2.0 * overlap / (n_a + n_b))


def best_threshold(df: DataFrame, score: str, gain: str) -> DataFrame:
    """The threshold at which keeping all rows up to it gains most: the first strict maximum of the running sum of ``gain``
    in the order of ``score``. Rows of one score are added up first; the sums run over ranges of the scores in parallel."""
    by = df.groupBy(score).agg(F.sum(gain).alias("_g"))
    run = running(by, [score], "_g", "_before").withColumn("total", F.col("_before") + F.col("_g"))
    return run.orderBy(F.desc("total"), score).limit(1).select(F.col(score).alias("threshold"), "total")


def bleu_counts(df: DataFrame, candidate: str, references: str, n: int) -> DataFrame:
    """Adds ``match_k`` and ``total_k`` for k up to ``n``: n-grams of the candidate, clipped by the reference that has most."""
    def joined(words: Column, k: int) -> Column:
        return F.transform(ngrams(words, k), lambda g: F.array_join(g, " "))

    def clipped(grams: Column, k: int) -> Column:
        refs = F.transform(F.col(references), lambda r: joined(r, k))

        def most(g: Column) -> Column:
            return F.array_max(F.transform(refs, lambda r: F.size(F.filter(r, lambda x: x == g))))

        return F.aggregate(F.array_distinct(grams), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(grams, lambda x: x == g)), most(g)))

    for k in range(1, n + 1):
        grams = joined(F.col(candidate), k)
        df = df.withColumn(f"match_{k}", clipped(grams, k)).withColumn(f"total_{k}", F.size(grams))
    return df


def bleu(df: DataFrame, n: int) -> DataFrame:
    """Corpus BLEU of the counts and ``cand_len``, ``ref_len``; a precision of zero counts as the smallest normal double."""
    tiny = 2.2250738585072014e-308
    sums = df.agg(*[F.sum(f"match_{k}").alias(f"m{k}") for k in range(1, n + 1)], *[F.sum(f"total_{k}").alias(f"t{k}") for k in range(1, n + 1)], F.sum("cand_len").alias("c"), F.sum("ref_len").alias("r"))
    logs = sum((F.ln(F.greatest(F.coalesce(F.try_divide(F.col(f"m{k}").cast("double"), F.col(f"t{k}").cast("double")), F.lit(0.0)), F.lit(tiny))) for k in range(1, n + 1)), F.lit(0.0))
    brevity = F.when(F.col("c") < F.col("r"), F.exp(1 - F.try_divide(F.col("r").cast("double"), F.col("c").cast("double")))).otherwise(1.0)
    return sums.select((brevity * F.exp(logs / n)).alias("bleu"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays: one row of the table is folded over ``a``."""
    def row(prev: Column, x: Column) -> Column:
        # new[j] = prev[j-1]+1 on a match, else the larger of prev[j] and new[j-1]
        step = F.transform(b, lambda y, j: F.when(x == y, F.coalesce(F.get(prev, j - 1), F.lit(0)) + 1).otherwise(F.get(prev, j)))
        return F.aggregate(step, F.array().cast("array<int>"), lambda acc, v: F.array_append(acc, F.greatest(v, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))

    zeros = F.transform(b, lambda _: F.lit(0))
    return F.coalesce(F.array_max(F.aggregate(a, zeros, row)), F.lit(0))


def rouge_n(df: DataFrame, candidate: str, reference: str, sizes: tuple[int, ...]) -> DataFrame:
    """``n, rouge``: the different n-grams both sides have, over those of the references; null where those have none."""
    def grams(column: str, n: int) -> Column:
        return F.array_distinct(F.transform(ngrams(F.col(column), n), lambda g: F.array_join(g, " ")))

    both = F.array(*[F.struct(F.lit(n).alias("n"), F.size(F.array_intersect(grams(candidate, n), grams(reference, n))).alias("hit"), F.size(grams(reference, n)).alias("all")) for n in sizes])
    return df.select(F.explode(both).alias("g")).groupBy("g.n").agg(F.try_divide(F.sum("g.hit").cast("double"), F.sum("g.all").cast("double")).alias("rouge"))


def rouge_l(precision: Column, recall: Column, gamma: float = 1.2) -> Column:
    """The F measure that weighs recall by gamma squared; 0 where both are."""
    return F.coalesce(F.try_divide((1 + gamma**2) * precision * recall, recall + gamma**2 * precision), F.lit(0.0))


def chunks(df: DataFrame, keys: list[str], order: str, tag: str) -> DataFrame:
    """``(keys, kind, first, last)``: the chunks that tags like B-X, I-X, E-X, S-X and O spell. A chunk begins at B or S, after
    E, S or O, and where the kind changes; it goes on to the next beginning or O."""
    by = W.partitionBy(*keys).orderBy(order)
    t = df.select(*keys, order, F.substring(tag, 1, 1).alias("_p"), F.expr(f"substring({tag}, 3)").alias("_k"))
    t = t.withColumn("_q", F.coalesce(F.lag("_p").over(by), F.lit("O"))).withColumn("_l", F.coalesce(F.lag("_k").over(by), F.lit("")))
    new = F.col("_p").isin("B", "S") | F.col("_q").isin("E", "S", "O") | (F.col("_k") != F.col("_l"))
    t = t.withColumn("_n", F.sum(new.cast("int")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).where("_p <> 'O'")
    return t.groupBy(*keys, F.col("_k").alias("kind"), "_n").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_n")


def sentence_rates(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """A row a metric of counts and rates over sentences that are ``bad`` or not: right where the metric's column holds; one
    that isn't bad is a false alarm where it isn't the ``same``. A rate of nothing is NaN."""
    bad, nan = F.col("bad"), F.lit(float("nan"))
    counts = [F.struct(F.lit(name).alias("metric"), F.count_if(bad & F.col(ok)).alias("tp"), F.count_if(~bad & ~F.col("same")).alias("fp"), F.count_if(bad & ~F.col(ok)).alias("fn")) for name, ok in metrics.items()]
    got = df.agg(F.array(*counts).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    rate = lambda n: F.when(F.col("tp") + F.col(n) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(n)), 9)).otherwise(nan)
    return got.select("metric", "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


def matches(gold: DataFrame, guess: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys of the rows, gold, guess)`` with 1 where the row is among them; both sides count a row once."""
    both = gold.withColumn("gold", F.lit(1)).withColumn("guess", F.lit(0)).unionByName(guess.withColumn("gold", F.lit(0)).withColumn("guess", F.lit(1)))
    return both.groupBy(*keys).agg(F.max("gold").alias("gold"), F.max("guess").alias("guess"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``label, tp, fp, fn`` of each class seen on either side."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("s"), (F.col(truth) == F.col(guess)).cast("int").alias("hit"))
    got = sides.groupBy("s.label").agg(F.sum(F.col("hit") * F.col("s.t")).alias("tp"), F.sum("s.g").alias("g"), F.sum("s.t").alias("t"))
    return got.select("label", "tp", (F.col("g") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def precision_recall(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1; a zero denominator gives 0."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), zero)
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), zero)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero))


def matthews(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """0 whenever any cell is 0."""
    zero = (tp == 0) | (fp == 0) | (tn == 0) | (fn == 0)
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    return F.when(zero, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
