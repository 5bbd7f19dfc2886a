"""Quality rules whose cutoffs limit false rejection, stratum by stratum.

Each text gets signals from 0 to 1000 (``SIGNALS``), the higher the worse. Labelled
rows are split by a hash of their id:

1. A third fits a path of cutoffs. On step i of the path a rule rejects the values
   that at most i of 1000 good texts of the stratum reach; a rule takes part
   if at the path's end it rejects a larger share of the bad texts than of the good.
2. The rest, which had no part in that, is the holdout. From step 0 on, each step's
   false rejections (good texts that any rule rejects) are tested: with a true
   rate of ``limit``, would so few be seen with a probability of at most
   ``risk / strata``? That is the exact binomial (Clopper-Pearson) bound at the level of
   Bonferroni's correction; within a stratum the steps are tested in a fixed
   order and the first failure ends them, which needs no further correction.

The last step passed gives the stratum's cutoffs. With a probability of at least
1 - ``risk`` no stratum loses more than ``limit`` of its good texts to all rules
together. A stratum with too few labels to prove that rejects nothing.

Signals are computed once, where the texts are read, and written to the
shared folder; labels are joined to that narrow table. Histograms have at most 1,001 values
per stratum and rule. Counts cover all documents, nothing is sampled.

Defined results: null and empty texts have no words, signals of 0, and fail the base
rules; a null stratum is a stratum of its own, as is a null id's; of several labels of
one id the worst counts; labels other than 0 and 1 and labels without a document are left out;
repeated documents count each time. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts, with_row
from quadrille.session import materialise

# Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
SHORTEST, MOST_REPEATED = 50, 50
SIGNALS = ("symbols", "repeated", "copied_lines", "shouting", "long_words")
TOP = 1000
# Steps of the path, in thousandths of the good texts; the share of good texts that may be lost, and the risk that it is more.
STEPS = 20
LIMIT, RISK = 0.02, 0.05

FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            + ", ".join(f"{s} int" for s in SIGNALS))


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in windows of three that are found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    # Two steps keep the keys below n * len(words), whatever n is.
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    keys = pairs[:-1] * np.int64(n) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(len(keys), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(keys) + k] |= often
    return int(inside.sum())


def _share(part: int, whole: int) -> int:
    return min(TOP, TOP * part // whole) if whole else 0


def features(text: str) -> tuple[int, ...]:
    """Counts and signals of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    # Code points of words: those of the text without its blanks.
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    copied = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    shouts = len(data) - len(data.translate(None, CAPITALS + b"!"))
    return (n, chars, symbols, copied, repeated,
            _share(symbols, n), _share(repeated, n), _share(copied, len(lines)), _share(shouts, chars), _share(chars, 50 * n))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs`` but the text) with the columns of FEATURES."""
    bound_batches(docs.sparkSession)
    names = [f.strip().split(" ")[0] for f in FEATURES.split(",")]

    def make():
        return lambda texts: dict(zip(names, zip(*map(features, texts), strict=True), strict=True))

    return map_texts(with_row(docs, text, drop_text=True), make, FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """The probability of at most ``k`` of ``n``."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def fits(doc_id: Column) -> Column:
    """Whether a labelled row fits the path (five of sixteen) or belongs to the holdout."""
    return F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1) < "5"


def path(fit: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per stratum with an array of cutoffs for each rule; TOP + 1 rejects nothing.

    ``fit`` has stratum, good and the signals.
    """
    long = fit.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(s).alias("rule"), F.col(s).alias("value")) for s in SIGNALS])).alias("r")).select("stratum", "good", "r.*")
    counts = long.groupBy("stratum", "rule", "value").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    rule = Window.partitionBy("stratum", "rule")
    above = rule.orderBy(F.desc("value"))
    reached = counts.select("stratum", "rule", "value", F.sum("good").over(above).alias("good"), F.sum("bad").over(above).alias("bad"),
                            F.sum("good").over(rule).alias("all_good"), F.sum("bad").over(rule).alias("all_bad"))
    # The lowest value that so few good texts reach; of values between those seen, the lowest.
    lower = F.coalesce(F.lead("value").over(above) + 1, F.lit(0))
    stepped = (reached.withColumn("cut", lower)
               .select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
               .withColumn("fits", F.col("good") * TOP <= F.col("step") * F.col("all_good")))
    cuts = stepped.groupBy("stratum", "rule", "step").agg(
        F.coalesce(F.min(F.when(F.col("fits"), F.col("cut"))), F.max("value") + 1).alias("cut"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("bad"))), F.lit(0)).alias("bad"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("good"))), F.lit(0)).alias("good"),
        F.first("all_good").alias("all_good"), F.first("all_bad").alias("all_bad"))
    end = Window.partitionBy("stratum", "rule")
    last_bad = F.max(F.when(F.col("step") == steps, F.col("bad"))).over(end)
    last_good = F.max(F.when(F.col("step") == steps, F.col("good"))).over(end)
    useful = last_bad * F.col("all_good") > last_good * F.col("all_bad")
    kept = cuts.withColumn("cut", F.when(useful, F.col("cut")).otherwise(TOP + 1))
    return kept.groupBy("stratum").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rule") == s, F.struct("step", "cut")))), lambda x: x["cut"]).alias(f"cut_{s}")
        for s in SIGNALS])


def step_of(steps: int = STEPS) -> Column:
    """The first step of the path on which any rule rejects; ``steps`` + 1: none."""
    def first(signal: str) -> Column:
        return F.coalesce(F.array_size(F.filter(f"cut_{signal}", lambda c: c > F.col(signal))), F.lit(steps + 1))

    return F.least(*map(first, SIGNALS))


def chosen_steps(holdout: DataFrame, steps: int = STEPS, limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """The last step passed for each stratum, -1 for none, from the ``step`` of each good row of the holdout."""
    counts = holdout.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("stratum").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("at"))
    strata = per.select(F.count(F.lit(1))).scalar()

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), limit) for a, b in zip(k, n, strict=True)])

    each = per.select("stratum", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    lost = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("step")), lambda i: F.coalesce(F.element_at("at", i), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    tested = each.select("stratum", "step", (tail(lost, F.col("n")) <= F.lit(risk) / strata).alias("passed"))
    return tested.groupBy("stratum").agg((F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.lit(steps + 1)) - 1).alias("chosen"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", quality: str = "quality", doc_id: str = "doc_id",
             limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """``row``, the columns of FEATURES, base_failed, ``step`` and ``chosen`` of its stratum, and ``kept``."""
    known = F.coalesce(F.concat(F.lit("="), F.col(f"row.{stratum}").cast("string")), F.lit(""))
    measured = materialise(signals(docs).withColumn("stratum", known), "signals")
    worst = (labels.filter(F.col(quality).isin(0, 1)).groupBy(F.col(doc_id).alias("labelled"))
             .agg((F.min(quality) == 1).alias("good")))
    labelled = measured.join(worst, F.col(f"row.{doc_id}") == F.col("labelled")).select("stratum", "good", *SIGNALS, fits(F.col("labelled")).alias("fit"))
    # A row per stratum: written, so that the planner sees how small it is and moves no rows to it.
    cuts = materialise(path(labelled.filter("fit")), "path")
    holdout = labelled.filter("NOT fit AND good").join(cuts, "stratum", "left").select("stratum", step_of().alias("step"))
    chosen = chosen_steps(holdout, limit=limit, risk=risk)
    # One row per stratum and narrow: small enough for any table whose strata are languages or sources, and left to the planner if not.
    rules = materialise(cuts.join(chosen, "stratum"), "cutoffs")
    judged = measured.join(rules, "stratum", "left")
    step = step_of()
    return judged.select("row", *[c for c in measured.columns if c not in ("row", "stratum")], base_failed().alias("base_failed"),
                         step.alias("step"), F.coalesce("chosen", F.lit(-1)).alias("chosen"),
                         (~base_failed() & (step > F.coalesce("chosen", F.lit(-1)))).alias("kept"))
