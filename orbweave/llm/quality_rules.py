"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one measure of a document with a cutoff for its stratum.  The cutoff is the
strictest of a fixed grid for which labelled good documents prove, by exact binomial tests, that
at most a given share of good documents is rejected.  The tests of a grid are a fixed sequence from
its loosest cutoff on, which needs no correction; strata and rules are corrected for by Bonferroni's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.session import stage

#: Separators of words, symbols, and the base rule.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Measures in thousandths, and for each the grid of cutoffs, the strictest first.
RULES = {
    "symbol_words": (20, 40, 60, 80, 100, 150, 200, 300, 400, 600, 800, 1000),
    "repeat_words": (20, 40, 60, 80, 100, 120, 150, 180, 210, 240, 270, 300),
    "dup_lines": (20, 40, 60, 100, 150, 200, 250, 300, 400, 500, 600, 800),
    "word_chars": (7000, 7500, 8000, 8500, 9000, 9500, 10000, 11000, 12000, 14000, 16000, 20000),
    "upper_chars": (40, 60, 80, 100, 150, 200, 250, 300, 400, 500, 700, 900),
}
EPSILON, DELTA = 0.02, 0.05


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the base measures of every whole text (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    step = docs.select(
        *keep,
        F.filter(F.split(flat, " +"), lambda w: w != "").alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    step = step.select(
        *keep, "word_chars", "n_symbols", "n_upper",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))
    none = F.array().cast("array<bigint>")
    step = step.withColumn(
        "v", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window)).otherwise(none)
    ).drop("h")
    # windows that occur again: neighbours in the order by hash; then how many words they cover together
    step = step.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("v")) < F.size("v"),
            F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("v")
    again = F.filter(
        "s",
        lambda x, k: (x["h"] == F.get(F.col("s"), k - 1)["h"]) | (x["h"] == F.get(F.col("s"), k + 1)["h"]),
    )
    step = step.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def with_rates(df: DataFrame) -> DataFrame:
    """The measures that rules compare, in thousandths (long), and base_failed."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")
    return df.select(
        "*",
        rate("n_symbols", "n_words").alias("r_symbol_words"),
        rate("n_repeat_words", "n_words").alias("r_repeat_words"),
        rate("n_dup_lines", "n_lines").alias("r_dup_lines"),
        rate("word_chars", "n_words").alias("r_word_chars"),
        rate("n_upper", "word_chars").alias("r_upper_chars"),
        (
            (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
        ).alias("base_failed"),
    )


def _log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1 by Stirling's series at x + 8 (error below 1e-13)."""
    y = x + F.lit(8.0)
    series = (
        (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    )
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + F.lit(float(k)))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial distribution, summed down from the term of k.

    Terms fall below that one faster than a geometric series, and the sum runs over 40 standard
    deviations and 200 more terms, after which they are below the precision of a double.
    """
    n, k = n.cast("double"), k.cast("double")
    first = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    steps = F.least(k, F.floor(40 * F.sqrt(n) + 200)).cast("int")
    run = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"),
            (a["sum"] + a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("sum"),
        ),
    )
    tail = F.least(F.exp(first + F.log(run["sum"])), F.lit(1.0))
    return F.when(k >= n, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).otherwise(tail)


def cutoffs(rates: DataFrame, labels: DataFrame, stratum: str, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """(stratum, c_<rule>...): the strictest proven cutoff of each rule, null where none is proven.

    The labelled documents of quality 1 that pass the base rule are the holdout: nothing else was
    fitted on them.  A cutoff is proven if the count of holdout documents above it would be so small
    with probability at most delta / (strata * rules) if the share were epsilon / rules, and all
    looser ones are proven too.  Looser cutoffs have counts no larger, so they are whenever it is,
    and the sequence from the loosest on ends at the strictest cutoff that passes by itself.  With
    probability 1 - delta no stratum's rules together reject more than ``epsilon`` of its good documents.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("l_doc")).distinct()
    held = rates.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("l_doc"), "left_semi")
    above = [
        F.sum(F.when(F.col(f"r_{rule}") > c, 1).otherwise(0)).alias(f"k_{rule}_{c}") for rule, grid in RULES.items() for c in grid
    ]
    counts = stage(held.groupBy(stratum).agg(F.count("*").alias("n"), *above), "strata")
    strata = max(counts.count(), 1)
    tests = [
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{rule}_{c}").alias("k"))
        for rule, grid in RULES.items()
        for c in grid
    ]
    rows = counts.select(stratum, "n", F.explode(F.array(*tests)).alias("t")).select(stratum, "n", "t.*")
    level = delta / (strata * len(RULES))
    proven = rows.where(binomial_tail(F.col("k"), F.col("n"), epsilon / len(RULES)) <= F.lit(level))
    chosen = [F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"c_{rule}") for rule in RULES]
    return proven.groupBy(stratum).agg(*chosen)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs(doc_id, text, <stratum>)``.

    A stratum without proven cutoffs (or null) keeps all that pass the base rule.  Null and empty
    texts fail the base rule.  Repeated rows each give a row; other columns are ignored.
    """
    rates = stage(with_rates(measures(docs, ["doc_id", stratum])), "rates")
    # staged, so that its size is known and Spark broadcasts it only below its threshold
    found = stage(cutoffs(rates, labels, stratum, epsilon, delta), "cutoffs")
    passed = F.lit(True)
    for rule in RULES:
        passed = passed & (F.col(f"c_{rule}").isNull() | (F.col(f"r_{rule}") <= F.col(f"c_{rule}")))
    return rates.join(found, stratum, "left").withColumn("kept", ~F.col("base_failed") & passed)
