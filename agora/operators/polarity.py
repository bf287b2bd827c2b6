"""A learned sentiment lexicon: labels spread over the words' co-occurrence graph (M2).

Words that stand within ``window`` words of each other in a comment are
joined by an edge, weighted by positive pointwise mutual information (how much
oftener they meet than their frequencies ask). A few seed words hold +1 or -1;
every other word takes the weighted mean of its neighbours, again and again,
until no score moves by ``tolerance`` (the harmonic solution over the graph) or
for a given number of rounds. Words that no seed reaches keep 0.

A comment's raw output is that of the word list's contract: with x the sum of
its words' scores over the sum of their sizes, the label is x's sign and the
confidence 0.5 + |x| / 2, so the threshold and the NEUTRAL default apply as for
any other scorer.

Scale: texts are read once into chunks of numbered words (``wordtexts``); a
chunk's distinct pairs are sorted, packed and dealt to buckets that add them
up; the graph is as large as the vocabulary
allows, not as the corpus. It is packed into blocks that are cached once and stay
where they are (``wordgraph``); a round sends a block the scores it needs as
packed numbers, and sums over arrays.

Null and empty texts have no words. A word next to itself makes no edge. Seeds
absent from the texts have no edges; they stay in the lexicon. An empty table
gives the seeds alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import sentiment_from_output
from agora.operators.wordgraph import Graph
from agora.operators.wordtexts import Texts, kept


def cooccurrences(comments: DataFrame | Texts, window: int = 2, min_pairs: int = 2, body: str = "body") -> DataFrame:
    """(a, b, n) with a < b: how often two different words stand within ``window`` words of each other, if
    ``min_pairs`` times or more. Of ``Texts``, a and b are the words' numbers."""
    if isinstance(comments, Texts):
        return comments.pairs(window, min_pairs)
    texts = Texts(comments, body=body)
    words = texts.vocabulary()
    named = (texts.pairs(window, min_pairs).join(words.select(F.col("id").alias("a"), F.col("word").alias("x")), "a")
             .join(words.select(F.col("id").alias("b"), F.col("word").alias("y")), "b"))
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def ppmi_weights(pairs: DataFrame, written: bool = False) -> DataFrame:
    """(word, neighbour, weight): both directions of every pair of positive PMI.

    A pair's weight is the same in both directions, so it is found on the pair, before the rows are doubled. Pairs
    (unless ``written``) and their words are read several times, so both are written once."""
    pairs = pairs if written else kept(pairs)
    met = kept(pairs.select(F.explode(F.array("a", "b")).alias("word"), "n")
                 .groupBy("word").agg(F.sum("n").alias("met")))
    total = met.agg(F.sum("met")).scalar()
    side = lambda k: met.select(F.col("word").alias(k), F.col("met").alias(f"met_{k}"))
    weight = F.log(F.col("n").cast("double") * total / (F.col("met_a").cast("double") * F.col("met_b")))
    weighted = (pairs.join(side("a"), "a").join(side("b"), "b")
                .select("a", "b", weight.alias("weight")).where(F.col("weight") > 0))
    return weighted.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("neighbour"), "weight"),
                                             F.struct(F.col("b").alias("word"), F.col("a").alias("neighbour"), "weight")))
                           .alias("e")).select("e.*")


def ppmi_edges(pairs: DataFrame) -> DataFrame:
    """(word, neighbour, share): both directions of every pair of positive PMI; a word's shares add up to 1."""
    weighted = ppmi_weights(pairs)
    sums = weighted.groupBy("word").agg(F.sum("weight").alias("sum"))
    return weighted.join(sums, "word").select("word", "neighbour", (F.col("weight") / F.col("sum")).alias("share"))


def seed_scores(spark, positive=None, negative=None) -> DataFrame:
    """(word, seed) of the seed words."""
    rows = [(w, 1.0) for w in (lexicon.POSITIVE_SEEDS if positive is None else positive)]
    rows += [(w, -1.0) for w in (lexicon.NEGATIVE_SEEDS if negative is None else negative)]
    return spark.createDataFrame(rows, "word string, seed double")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, tolerance: float = 1e-3,
              max_rounds: int = 100, stride: int = 4, most: int | None = None) -> DataFrame:
    """(word, score) of all words of the graph and all seeds, after ``rounds`` rounds or, if not given, when no
    score moves by ``tolerance`` in ``stride`` rounds any more (``max_rounds`` at most). Scores are written
    every ``stride`` rounds, as a round alone is a small job. ``edges`` has shares, or weights whose sum per word
    divides; they are ``most`` in number (they are written and counted if that is not given)."""
    graph = Graph(edges, seeds, most)
    state, done, last = None, 0, max_rounds if rounds is None else rounds
    while done < last:
        state = graph.advance(state, min(stride, last - done))
        done += stride
        if rounds is None:
            moved = state.agg(F.max("moved")).first()[0]  # one number
            if moved is None or moved < tolerance:
                break
    scores = kept(graph.scores(state))
    graph.release()
    return scores


def learn(comments: DataFrame | Texts, positive=None, negative=None, window: int = 2, min_pairs: int = 2,
          rounds: int | None = None, body: str = "body") -> DataFrame:
    """(word, score) in [-1, 1], learned from ``comments``. Between texts and lexicon, words are numbers."""
    texts = comments if isinstance(comments, Texts) else Texts(comments, body=body)
    pairs = kept(cooccurrences(texts, window, min_pairs))
    seeds = seed_scores(texts.spark, positive, negative)
    known = kept(seeds.join(texts.vocabulary(), "word", "left"))
    scores = propagate(ppmi_weights(pairs, written=True), known.where("id IS NOT NULL").select(F.col("id").alias("word"), "seed"),
                       rounds, most=2 * pairs.count())
    named = scores.withColumnRenamed("word", "id").join(texts.vocabulary(), "id").select("word", "score")
    return kept(named.unionAll(known.where("id IS NULL").select("word", F.col("seed").alias("score"))))


def raw_output(total: Column, size: Column) -> tuple[Column, Column]:
    """(label, confidence) of a comment from the sum of its words' scores and the sum of their sizes."""
    x = F.try_divide(total, size)
    label = F.when(x > 0, "POSITIVE").when(x < 0, "NEGATIVE").otherwise("NEUTRAL")
    return label, F.coalesce(F.lit(0.5) + F.abs(x) / 2, F.lit(0.0))


def score(comments: DataFrame | Texts, learned: DataFrame, least: float = 0.05, key: str = "comment_id",
          body: str = "body") -> DataFrame:
    """M2: (key, sentiment) of every comment. Words whose score is below ``least`` in size don't count.

    A chunk of comments looks up each of its distinct words once, at the shard of the lexicon that holds it; the
    comments' own words are neither joined nor shuffled.
    """
    texts = comments if isinstance(comments, Texts) else Texts(comments, key, body)
    label, confidence = raw_output(F.col("total"), F.col("size"))
    return texts.sums(learned.where(F.abs("score") >= least)).select(
        F.col("key").alias(key),
        F.when(F.col("blank"), "NEUTRAL").otherwise(sentiment_from_output(label, confidence)).alias("sentiment"))
