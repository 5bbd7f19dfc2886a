"""The k best candidates of each text by TF-IDF cosine, from impact-ordered inverted lists.

Scores are those of ``similarity.tfidf_similarity``. Where the lists of a query's words are short on
average (``DIRECT`` rows, counted first), every pair that shares a word is scored; a threshold costs more there
than it saves. Elsewhere there is no row for every such pair. The impact of a word in a candidate is its weight over a
lower bound of the candidate's norm, so the sum of query weight times impact over
the shared words bounds the score from above.

1. ``postings`` (token, level, impact, candidate, ...): a list is cut into levels, four to
   each halving of the impact, so the high end of a list is found by an equality join.
2. The candidates of highest impact of a query's strongest words are scored exactly;
   the kth of these scores is the threshold that every further candidate has to reach.
3. A query's words are put in order, longest lists first. A candidate whose last shared word
   is the ith can score at most the bounds of the words before plus its own impact there, so list i
   is read only down to the impact that this leaves open. Lists of stop words come first, where
   nothing is left open, and are not read at all.
4. What these reads find is scored exactly, and the k best stay.

No list is gathered in a task; champions are limited before they are shuffled. Texts, reads and pairs are dealt
out by query to as many tasks as their counted rows ask for, so that what a task holds does not grow with their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.similarity import words
from quadrille.session import deal, materialise

# Strongest words of a query, and champions of each as a multiple of k, that set the threshold.
STRONGEST, CHAMPIONS = 8, 2
LEVELS = 64
# Rows of lists a query, on average, up to which all of them are scored; rows of a table that travels with the tasks.
DIRECT, LISTS_SENT = 2_000, 200_000
# Thresholds give way by this much, so that no tie is lost to rounding.
ROOM = 1e-8


@dataclass(frozen=True)
class TextIndex:
    """Inverted lists, statistics of words and squared norms of candidates; ``total`` is the corpus with one query in it."""

    postings: DataFrame
    tokens: DataFrame
    norms: DataFrame
    total: float


def _counts(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """Words of each text; texts are dealt out by their words, or by the ``rows`` they become if these are more."""
    # A word and the gap behind it take three characters or more.
    most = (df.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // 3
    return (deal(df.select(key, "text"), key, total=max(most, rows)).select(key, F.explode(words(F.col("text"))).alias("token"))
            .groupBy(key, "token").agg(F.count("*").cast("double").alias("tf")))


def _meet(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left``, dealt out by query, with its rows of ``right``; dealt out again where ``right`` is too long to travel."""
    if right.count() <= LISTS_SENT:
        return left.join(F.broadcast(right), on, how)
    return deal(left.join(right, on, how), "query", total=total)


def _level(impact: Column) -> Column:
    return F.least(F.lit(LEVELS), F.floor(-4 * F.log2(F.least(impact, F.lit(1.0))))).cast("int")


def index_texts(candidates: DataFrame) -> TextIndex:
    """Lists of the words of ``candidates`` (``candidate``, ``text``), written to the shared folder."""
    counts = materialise(_counts(candidates, "candidate"), "counts")
    total = candidates.count() + 2.0
    lengths = counts.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    weighted = (counts.join(lengths, "token")
                .withColumn("i0", F.log(total / (F.col("df") + 1)) + 1).withColumn("i1", F.log(total / (F.col("df") + 2)) + 1))
    norms = materialise(weighted.groupBy("candidate").agg(
        F.sum(F.pow(F.col("tf") * F.col("i0"), 2)).alias("cn"), F.sum(F.pow(F.col("tf") * F.col("i1"), 2)).alias("least")), "norms")
    impact = F.col("tf") * F.col("i1") / F.sqrt("least")
    postings = weighted.join(norms, "candidate").withColumn("impact", impact)
    postings = materialise(postings.select("token", _level(F.col("impact")).alias("level"), "impact", "candidate", "tf", "i0", "i1"), "postings")
    tokens = materialise(postings.groupBy("token").agg(F.count("*").alias("df"), F.first("i1").alias("i1"), F.max("impact").alias("top"),
                                                       F.min("level").alias("first"), F.max("level").alias("last")), "tokens")
    return TextIndex(postings, tokens, norms, total)


def _met(queries: DataFrame, index: TextIndex) -> int:
    """Rows of the lists of all words of the queries."""
    each = queries.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return each.join(index.tokens.select("token", "df"), "token").agg(F.sum(F.col("n") * F.col("df"))).first()[0] or 0


def _known(queries: DataFrame, index: TextIndex, rows: int = 0) -> DataFrame:
    """Words of the queries that some candidate has, with the query's squared norm over all its words."""
    unknown = F.log(F.lit(index.total) / 2) + 1
    counts = _counts(queries.filter(F.col("query").isNotNull()), "query", rows).withColumnRenamed("tf", "tq")
    known = counts.join(F.broadcast(index.tokens) if index.tokens.count() <= LISTS_SENT else index.tokens, "token", "left")
    return (known.withColumn("i1", F.coalesce("i1", unknown))
            .withColumn("qn", F.sum(F.pow(F.col("tq") * F.col("i1"), 2)).over(Window.partitionBy("query"))).filter(F.col("df").isNotNull()))


def _weights(queries: DataFrame, index: TextIndex) -> DataFrame:
    """Words of the queries that some candidate has: weight, bound, and the bounds of all words before."""
    before = Window.partitionBy("query").orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, -1)
    return (_known(queries, index).withColumn("weight", F.col("tq") * F.col("i1") / F.sqrt("qn"))
            .withColumn("bound", F.col("weight") * F.col("top"))
            .withColumn("before", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
            .select("query", "token", "tq", "qn", "weight", "bound", "before", "top", "first", "last"))


def _sums(words_of_pairs: DataFrame, on: list[str], index: TextIndex, pairs: int) -> DataFrame:
    """The exact scores of pairs from the words of their queries, which are dealt out by query."""
    lists = index.postings.select("candidate", "token", (F.col("tf") * F.pow("i1", 2)).alias("part"),
                                  (F.pow("tf", 2) * (F.pow("i1", 2) - F.pow("i0", 2))).alias("less"))
    sums = _meet(words_of_pairs, lists, on, pairs).groupBy("query", "candidate").agg(
        F.sum(F.col("tq") * F.col("part")).alias("dot"), F.sum("less").alias("fix"), F.first("qn").alias("qn"))
    return _meet(sums, index.norms.select("candidate", "cn"), ["candidate"], pairs).select(
        "query", "candidate", (F.col("dot") / (F.sqrt("qn") * F.sqrt(F.col("cn") + F.col("fix")))).alias("score"))


def all_scores(queries: DataFrame, index: TextIndex, met: int | None = None) -> DataFrame:
    """The score of every pair that shares a word; ``met`` saves counting the rows of the lists."""
    met = _met(queries, index) if met is None else met
    pairs = min(met, queries.count() * int(index.total))
    return _sums(_known(queries, index, pairs).select("query", "token", "tq", "qn"), ["token"], index, pairs)


def _scores(pairs: DataFrame, weights: DataFrame, index: TextIndex) -> DataFrame:
    """The exact score of each pair: its query's words meet the candidate's."""
    total = pairs.count()
    shared = deal(pairs, "query", total=total).join(weights.select("query", "token", "tq", "qn"), "query")
    return _sums(shared, ["candidate", "token"], index, total)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best, scores compared at 9 places, ties to the smallest candidate."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "candidate")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def open_pairs(weights: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """(query, candidate) pairs that the threshold leaves open, the k best of each query among them."""
    by_impact = Window.partitionBy("token").orderBy(F.desc("impact"), "candidate")
    champions = (index.postings.select("token", "impact", "candidate").withColumn("r", F.row_number().over(by_impact))
                 .filter(F.col("r") <= CHAMPIONS * k).select("token", "candidate"))
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "token")
    strong = (deal(weights, "query").select("query", "token", "bound").withColumn("r", F.row_number().over(by_bound))
              .filter(F.col("r") <= STRONGEST).select("query", "token"))
    strong = materialise(strong, "strongest")
    most = strong.count() * CHAMPIONS * k
    first = materialise(_meet(deal(strong, "query", total=most), champions, ["token"], most).select("query", "candidate").distinct(), "first")
    threshold = _best(_scores(first, weights, index), k).filter(F.col("rank") == k).select("query", (F.col("score") - ROOM).alias("threshold"))
    open_down_to = (F.coalesce("threshold", F.lit(0.0)) - F.col("before")) / F.col("weight")
    reads = (deal(weights, "query").join(materialise(threshold, "thresholds"), "query", "left")
             .withColumn("least", F.greatest(open_down_to, F.lit(0.0)))
             .filter(F.col("least") <= F.col("top") + ROOM)
             .withColumn("deepest", F.when(F.col("least") > 0, F.least(F.col("last"), _level(F.col("least")))).otherwise(F.col("last")))
             .select("query", "token", "least", F.explode(F.sequence(F.col("first"), F.greatest("first", "deepest"))).alias("level")))
    reads = materialise(reads, "reads")
    sizes = index.postings.groupBy("token", "level").agg(F.count("*").alias("n"))
    most = reads.join(sizes, ["token", "level"]).agg(F.sum("n")).first()[0] or 0
    lists = index.postings.select("token", "level", "impact", "candidate")
    return (_meet(deal(reads, "query", total=most), lists, ["token", "level"], most)
            .filter(F.col("impact") >= F.col("least") - ROOM).select("query", "candidate").distinct())


def top_k(queries: DataFrame, candidates: DataFrame | TextIndex, k: int) -> DataFrame:
    """(query, candidate, score, rank) of the k best candidates that share a word with the query.

    ``queries``: ``query``, ``text``; ``candidates``: ``candidate``, ``text``, or their index.
    """
    index = candidates if isinstance(candidates, TextIndex) else index_texts(candidates)
    met = _met(queries, index)
    if met <= DIRECT * queries.count():
        return _best(all_scores(queries, index, met), k)
    weights = materialise(_weights(queries, index), "weights")
    return _best(_scores(materialise(open_pairs(weights, index, k), "open"), weights, index), k)
