"""Stance with the target as an input: crossed features of text and target, and a multinomial model (M1).

A word near a mention of a target term (within ``window`` words) gives one
feature with its side ('before' or 'after' the nearest mention on that side)
and one without; any other word gives a 'far' feature. So the same text has
other features for another target, and the model can learn that praise next to
the target supports it while praise elsewhere says little. Terms of several
words are looked for word by word; the mentions themselves carry no feature
but 'mention'.

The features are array expressions of the row (no Python, no shuffle), hashed
into ``buckets`` counts. The model is Spark ML's multinomial logistic
regression, whose gradients are summed by a tree of tasks; what reaches the
driver is buckets x labels, however many comments there are.

Null or blank text -> NEUTRAL. A null or empty target has no mentions, so all
words are far. Training rows with a null or unknown stance are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import stance_from_index
from agora.functions.text import is_blank, split_terms, word_tokens

BUCKETS = 1 << 14


def target_words(raw_terms: Column) -> Column:
    """Distinct lower-case words of comma-separated target terms."""
    return F.array_distinct(F.flatten(F.transform(split_terms(raw_terms), word_tokens)))


def features(df: DataFrame, window: int = 5, body: str = "body", target: str = "target_terms") -> DataFrame:
    """``df`` with ``features`` (array of strings), the crossed features of ``body`` and ``target``."""
    t = df.withColumns({"_words": word_tokens(F.col(body)), "_target": target_words(F.col(target))})
    t = t.withColumn("_hit", F.transform("_words", lambda w: F.array_contains("_target", w)))

    def mentioned(start: Column, length: Column) -> Column:
        return F.array_contains(F.slice("_hit", start, length), True).cast("int")

    def side(hit: Column, i: Column) -> Column:
        """4 for a mention; else 1 if a mention stands before the word, plus 2 if one stands after it."""
        first = F.greatest(i - window, F.lit(0))
        return F.when(hit, F.lit(4)).otherwise(
            mentioned(first + 1, i - first) + F.lit(2) * mentioned(i + 2, F.lit(window)))

    def crossed(word: Column, at: Column) -> Column:
        near, after, before = (F.concat(F.lit(kind), word) for kind in ("near ", "after ", "before "))
        return (F.when(at == 0, F.array(F.concat(F.lit("far "), word)))
                .when(at == 4, F.array(F.lit("mention")))
                .when(at == 3, F.array(near, after, before))
                .when(at == 1, F.array(near, after))
                .otherwise(F.array(near, before)))

    # a word's side is found once, as a number; without a mention all words are far
    t = t.withColumn("_side", F.when(F.array_contains("_hit", True), F.transform("_hit", side)))
    far = F.transform("_words", lambda w: F.concat(F.lit("far "), w))
    crossing = F.when(F.col("_side").isNull(), far).otherwise(F.flatten(F.zip_with("_words", "_side", crossed)))
    return t.withColumn("features", crossing).drop("_words", "_target", "_hit", "_side")


@dataclass
class StanceModel:
    hashing: HashingTF
    logistic: LogisticRegressionModel
    window: int
    body: str
    target: str

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``stance``."""
        crossed = features(df, self.window, self.body, self.target)
        scored = self.logistic.transform(self.hashing.transform(crossed))
        label = stance_from_index(F.col("prediction").cast("int"))
        return scored.select(*df.columns, F.when(is_blank(F.col(self.body)), "NEUTRAL").otherwise(label).alias("stance"))


def fit(labelled: DataFrame, window: int = 5, buckets: int = BUCKETS, regularisation: float = 0.01,
        rounds: int = 50, body: str = "body", target: str = "target_terms", stance: str = "stance") -> StanceModel:
    """Fit on rows of (body, target, stance). No usable row is an error."""
    index = F.array_position(F.array(*[F.lit(s) for s in lexicon.STANCES]), F.col(stance)) - 1
    rows = (features(labelled.withColumn("_label", index.cast("double")).where("_label >= 0"), window, body, target)
            .select("_label", "features"))
    hashing = HashingTF(inputCol="features", outputCol="_counts", numFeatures=buckets)
    counted = hashing.transform(rows).select("_label", "_counts").persist()
    try:
        if counted.isEmpty():
            raise ValueError("no row with a known stance to learn from")
        logistic = LogisticRegression(featuresCol="_counts", labelCol="_label", family="multinomial",
                                      regParam=regularisation, maxIter=rounds).fit(counted)
    finally:
        counted.unpersist()
    return StanceModel(hashing, logistic, window, body, target)
