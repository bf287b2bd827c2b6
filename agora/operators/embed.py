"""Comment embeddings.

Default embedder: Spark ML HashingTF (384 buckets) -> IDF -> L2 Normalizer
over the comment tokens, a built-in, distributed stand-in for the sentence
model (which is not shipped). Output is ``array<float>`` rounded to 6 dp;
zero vectors (blank text) are not stored and are counted as errors.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.text import word_tokens


def embed(comments: DataFrame, dim: int = lexicon.EMBEDDING_DIM) -> DataFrame:
    """M4: (comment_id, body) -> (comment_id, embedding, is_zero)."""
    toks = comments.select("comment_id", word_tokens(F.col("body")).alias("tokens"))
    model = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="vec", p=2.0),
    ]).fit(toks)
    arr = F.transform(vector_to_array(F.col("vec"), "float32"),
                      lambda x: F.round(x.cast("double"), 6).cast("float"))
    out = model.transform(toks).select("comment_id", arr.alias("embedding"))
    return out.withColumn("is_zero", ~F.exists("embedding", lambda x: x != 0))


def persistable(embedded: DataFrame) -> DataFrame:
    """Keep only non-zero vectors."""
    return embedded.where(~F.col("is_zero")).drop("is_zero")


def embed_counts(embedded: DataFrame) -> DataFrame:
    """Embedded / error counts of one run (zero vectors are errors)."""
    return embedded.agg(F.count_if(~F.col("is_zero")).alias("embedded"),
                        F.count_if(F.col("is_zero")).alias("errors"))


def unembedded(comments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Comments with a body and no stored vector."""
    return (comments.where(F.col("body").isNotNull() & (F.col("body") != ""))
            .join(vectors.select("comment_id"), "comment_id", "left_anti"))


def vectors_from_json(df: DataFrame, col: str = "embedding_vector") -> DataFrame:
    """Legacy JSON-text vectors -> array<float>; malformed rows dropped."""
    parsed = F.from_json(F.col(col), "array<float>")
    return df.withColumn("embedding", parsed).where(F.col("embedding").isNotNull())


def vectors_to_json(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("embedding_vector", F.to_json(F.col(col)))
