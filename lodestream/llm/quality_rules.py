"""Quality rules as weak supervision (operator 4), DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null) on a document. The joint vote patterns
are counted (at most 3^rules rows, however large the corpus), expectation-maximisation on
that small table estimates every rule's accuracy on good and on bad documents and the share
of good ones, and a document is kept when its posterior probability of being good reaches
the threshold. No rule alone rejects a document.

Cases: a null or empty text has no words and fails the base; extra columns are ignored;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, whole_text

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def with_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the
    letter counts that rules use. One pass over the rows, no shuffle.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes beside their
    positions within the row; a window is repeated when a neighbour has its hash.
    """
    own = "__q_"
    t = f"{own}t"
    df = docs.withColumn(t, whole_text(text))
    df = df.withColumn(f"{own}trim", F.btrim(F.col(t), F.lit(WHITE)))
    df = df.withColumn(
        f"{own}w",
        F.when(F.col(f"{own}trim") == "", F.expr("cast(array() as array<string>)"))
        .otherwise(F.split(f"{own}trim", r"[\x20\x09-\x0D]+")),
    )
    w = F.col(f"{own}w")
    n = F.size(w)
    inner = F.greatest(n - 2, F.lit(0))
    trigrams = F.transform(
        F.arrays_zip(
            F.slice(w, F.lit(1), inner).alias("a"), F.slice(w, F.lit(2), inner).alias("b"),
            F.slice(w, F.lit(3), inner).alias("c"),
        ),
        lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    length = F.length(F.col(t))

    def without(chars: str) -> Column:
        return F.length(F.translate(F.col(t), chars, ""))

    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": without(WHITE).cast("long"),
        "n_symbols": (length - without(SYMBOLS)).cast("long"),
        "n_upper": (length - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "n_stops": (length - without(".!?")).cast("long"),
        "n_marks": (length - without("!")).cast("long"),
        f"{own}g": F.when(n >= 4, trigrams).otherwise(F.expr("cast(array() as array<bigint>)")),
        f"{own}l": lines,
    })
    g, ls = F.col(f"{own}g"), F.col(f"{own}l")
    df = df.withColumns({
        "n_lines": F.size(ls).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        f"{own}s": F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.arrays_zip(g.alias("h"), F.sequence(F.lit(0), F.size(g) - 1).alias("p"))),
        ),
    })
    s = F.col(f"{own}s")
    repeated = F.filter(s, lambda x, i: (
        F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    ))
    df = df.withColumn(f"{own}p", F.sort_array(F.transform(repeated, lambda x: x["p"])))
    covered = F.aggregate(
        F.col(f"{own}p"), F.struct(F.lit(-3).alias("at"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(x.alias("at"), (a["sum"] + F.least(F.lit(3), x - a["at"])).alias("sum")),
    )["sum"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop(t, f"{own}trim", f"{own}w", f"{own}g", f"{own}l", f"{own}s", f"{own}p")


@dataclass(frozen=True)
class Rule:
    """bad and good are SQL conditions; neither true means that the rule abstains."""

    name: str
    bad: str
    good: str


#: A rule speaks for a text only where the text is plain at all: no rule's good word on its own
#: matter is evidence against what another one has found.
PLAIN = "n_symbols <= 0.1 * n_words and n_upper < 0.2 * word_chars and n_repeat_words < 0.3 * n_words"

#: Conditions are over the counts.
RULES = (
    Rule("symbols", "n_symbols > 0.3 * n_words", f"n_symbols <= 0.02 * n_words and {PLAIN}"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2.5 * n_words",
         f"word_chars between 3.5 * n_words and 9 * n_words and {PLAIN}"),
    Rule("shouting", "n_upper > 0.4 * word_chars", f"n_upper < 0.08 * word_chars and {PLAIN}"),
    Rule("repeated_windows", "n_repeat_words > 0.4 * n_words", f"n_repeat_words < 0.1 * n_words and {PLAIN}"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", f"n_dup_lines = 0 and n_lines > 1 and {PLAIN}"),
    Rule("sentence_ends", "n_words > 50 and 200 * n_stops < n_words",
         f"n_stops between 0.02 * n_words and 0.3 * n_words and {PLAIN}"),
    Rule("exclaiming", "n_marks > 0.3 * n_words", f"n_marks < 0.05 * n_words and {PLAIN}"),
    Rule("length", "n_words < 20", f"n_words >= 80 and {PLAIN}"),
)


def with_votes(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds votes: one character a rule, g, b or '-' for abstaining."""
    votes = F.concat(*[
        F.when(F.expr(r.bad), "b").when(F.expr(r.good), "g").otherwise("-") for r in rules
    ])
    return df.withColumn("votes", votes)


@dataclass(frozen=True)
class Fit:
    """Share of good documents; of each rule, the chance that it votes good on a good document
    and bad on a bad one, when it votes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def posterior(votes: Column, fit: Fit) -> Column:
    """P(good | votes) under independent rules: an abstaining rule says nothing."""
    odds = F.lit(math.log(fit.prior / (1 - fit.prior)))
    for j, (g, b) in enumerate(zip(fit.good, fit.bad, strict=True)):
        v = F.substring(votes, j + 1, 1)
        odds = odds + F.when(v == "g", math.log(g / (1 - b))).when(v == "b", math.log((1 - g) / b)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fit_rules(patterns: DataFrame, m: int, rounds: int = 40, smooth: float = 2.0, floor: float = 0.6,
              ceiling: float = 0.97, edge: float = 0.02) -> Fit:
    """Expectation-maximisation over the table of vote patterns (votes, n), of at most 3^m rows:
    all rounds run inside one expression over the patterns as an array, so fitting is one job.

    Accuracies start at 0.9, draw `smooth` votes of that accuracy and stay within [floor,
    ceiling]: a rule is never believed to be worse than chance (which also fixes which class is
    which) nor to be infallible. The share of good documents stays `edge` away from 0 and 1,
    where one class would have no documents left to fit its accuracies.
    """
    rules = F.sequence(F.lit(0), F.lit(m - 1))

    def round_(state: Column, table: Column) -> Column:
        log_good = F.transform(rules, lambda j: F.log(F.get(state["good"], j) / (1 - F.get(state["bad"], j))))
        log_bad = F.transform(rules, lambda j: F.log((1 - F.get(state["good"], j)) / F.get(state["bad"], j)))
        prior = F.log(state["prior"] / (1 - state["prior"]))

        def judged(words: Column) -> Column:
            def one(x: Column) -> Column:
                odds = F.aggregate(rules, words["prior"], lambda a, j: a + F.when(F.get(x["v"], j) == 1, F.get(words["g"], j)).when(
                    F.get(x["v"], j) == -1, F.get(words["b"], j)).otherwise(0.0))
                return F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["n"] / (1 + F.exp(-odds))).alias("good"))

            return F.transform(table, one)

        def sums(seen: Column) -> Column:
            def of(j: Column, vote: int, weight) -> Column:
                both = F.aggregate(seen, F.struct(F.lit(0.9 * smooth).alias("right"), F.lit(smooth).alias("all")), lambda a, x: F.struct(
                    (a["right"] + F.when(F.get(x["v"], j) == vote, weight(x)).otherwise(0.0)).alias("right"),
                    (a["all"] + F.when(F.get(x["v"], j) != 0, weight(x)).otherwise(0.0)).alias("all")))
                return _let(both, lambda t: F.least(F.lit(ceiling), F.greatest(F.lit(floor), t["right"] / t["all"])))

            total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x["n"])
            good = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x["good"])
            return F.struct(
                F.least(F.lit(1 - edge), F.greatest(F.lit(edge), good / total)).alias("prior"),
                F.transform(rules, lambda j: of(j, 1, lambda x: x["good"])).alias("good"),
                F.transform(rules, lambda j: of(j, -1, lambda x: x["n"] - x["good"])).alias("bad"))

        return _let(F.struct(prior.alias("prior"), log_good.alias("g"), log_bad.alias("b")), lambda words: _let(judged(words), sums))

    votes = F.transform(rules, lambda j: F.when(F.substr("votes", j + 1, F.lit(1)) == "g", 1).when(F.substr("votes", j + 1, F.lit(1)) == "b", -1).otherwise(0))
    start = F.struct(F.lit(0.8).alias("prior"), F.array_repeat(F.lit(0.9), m).alias("good"), F.array_repeat(F.lit(0.9), m).alias("bad"))
    table = patterns.select(F.struct(votes.alias("v"), F.col("n").cast("double").alias("n")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("t"))
    fitted = F.when(F.size("t") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: round_(state, F.col("t")))).otherwise(start)
    row = table.select(fitted.alias("fit")).first().fit
    return Fit(row.prior, tuple(row.good), tuple(row.bad))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept of every row."""
    seen = with_votes(with_word_counts(docs.select("doc_id", "text")), rules)
    seen = cut(seen.drop("text"), "quality")
    fit = fit_rules(seen.groupBy("votes").agg(F.count("*").alias("n")), len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.withColumns({"base_failed": failed, "p_good": posterior(F.col("votes"), fit)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes",
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base or the posterior go. The rows are written
    beside their counts once, without a shuffle, and read again when the rules are fitted.
    Whatever columns docs has come back as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    counted = cut(with_votes(with_word_counts(packed)).select("__doc", "n_words", "n_repeat_words", "votes"), "quality")
    fit = fit_rules(counted.groupBy("votes").agg(F.count("*").alias("n")), len(RULES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = counted.filter(~failed & (posterior(F.col("votes"), fit) >= 0.5))
    return kept.select("__doc.*")
