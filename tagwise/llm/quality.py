"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  A text is good or of one of several kinds of junk, as many as there are
rules: kinds hardly overlap, so that most rules call any junk text good, and one class of "bad" texts would be taken over by
the commonest kind.  Expectation-maximisation over the counts of vote patterns estimates how often each rule votes each way
on good texts and on each kind; nothing bounds the estimates.  The posterior probability of "good" replaces the usual "all
rules must pass".  There are at most ``3 ** len(RULES)`` patterns whatever the input, so that the iterations need no cluster;
the counts and features come from all texts.

Null text: no words, all figures 0.  Empty tables give empty results.  Repeated rows are judged each, and alike.  Other
columns, whatever their names, are not looked at, and the id may have any name but those of the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Fixed sets of characters.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Texts that each class is thought to have seen before; spread over the votes of a rule.
ITERATIONS, SMOOTHING = 60, 1.0
#: Where the iterations start: the share of good texts; votes (1, 0, -1) of a rule on its own kind of junk, and on all others.
PRIOR_GOOD, OWN, OTHER = 0.8, (0.15, 0.15, 0.7), (0.84, 0.15, 0.01)
VOTES = (1, 0, -1)

#: name, votes bad if, votes good if (else it abstains); per cent of words, characters or lines.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    ("lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
)


def _repeat_words(w: Column) -> tuple[Column, Column]:
    """Words in 3-word windows found twice or more.  Windows are sorted with their places, equal neighbours give places."""
    windows = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    )
    n = "size(__s)"
    places = F.expr(
        f"array_sort(transform(filter(sequence(0, {n} - 1), j -> (j > 0 AND __s[j - 1].h = __s[j].h) OR (j < {n} - 1 AND __s[j + 1].h = __s[j].h)), j -> __s[j].i))"
    )
    return windows, places


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of each whole text; one row per row of ``docs``, without its text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    windows, places = _repeat_words(F.col("__w"))
    return (
        docs.select(F.col(id_col).alias("__id"), t.alias("__t"), words.alias("__w"), lines.alias("__lines"))
        .select(
            "__id",
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.length(F.regexp_replace("__t", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
            F.when(F.size("__w") >= 3, windows).alias("__s"),
        )
        .withColumn("__p", F.when(F.col("__s").isNotNull(), places))
        .withColumn(
            "n_repeat_words",
            F.when(
                F.size("__p") > 0,
                F.expr("aggregate(transform(sequence(1, size(__p)), j -> CASE WHEN j = size(__p) THEN 3L ELSE least(3L, CAST(__p[j] - __p[j - 1] AS LONG)) END), 0L, (a, x) -> a + x)"),
            ).otherwise(F.lit(0).cast("long")),
        )
        .drop("__s", "__p")
        .withColumnRenamed("__id", id_col)
    )


def vote(rule: tuple[str, str, str]) -> Column:
    return F.expr(f"CASE WHEN {rule[1]} THEN -1 WHEN {rule[2]} THEN 1 ELSE 0 END").alias(f"vote_{rule[0]}")


#: Logarithms of the classes' shares, good first, and for each class and rule of the probability of each vote.
Model = tuple[list[float], list[list[dict[int, float]]]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> Model:
    """EM over (votes, count).  Class 0 is good, class r the kind of junk that rule r - 1 is made for; that is where the
    iterations start from, and what keeps "good" the class in which no rule stands out."""
    log = math.log
    shares = [log(PRIOR_GOOD)] + [log((1 - PRIOR_GOOD) / rules)] * rules
    table = [[dict(zip(VOTES, map(log, OWN if k == r + 1 else OTHER), strict=True)) for r in range(rules)] for k in range(rules + 1)]
    for _ in range(ITERATIONS):
        total = [SMOOTHING] * len(shares)
        sums = [[dict.fromkeys(VOTES, SMOOTHING / 10) for _ in range(rules)] for _ in shares]
        for votes, n in patterns:
            for k, p in enumerate(posterior((shares, table), votes)):
                total[k] += n * p
                for r, v in enumerate(votes):
                    sums[k][r][v] += n * p
        shares = [log(x / sum(total)) for x in total]
        table = [[{v: log(s[v] / sum(s.values())) for v in VOTES} for s in by_rule] for by_rule in sums]
    return shares, table


def posterior(model: Model, votes: tuple[int, ...]) -> list[float]:
    """Probability of each class given the votes."""
    logs = [share + sum(t[v] for t, v in zip(by_rule, votes, strict=True)) for share, by_rule in zip(*model, strict=True)]
    weights = [math.exp(x - max(logs)) for x in logs]
    return [w / sum(weights) for w in weights]


def p_good(model: Model, names: list[str]) -> Column:
    """Probability of the first class as a column over vote columns."""
    shares, table = model
    others = F.lit(0.0)
    for k in range(1, len(shares)):
        lead = F.lit(shares[k] - shares[0])
        for r, name in enumerate(names):
            d = {v: table[k][r][v] - table[0][r][v] for v in VOTES}
            lead = lead + F.when(F.col(name) == 1, d[1]).when(F.col(name) == -1, d[-1]).otherwise(d[0])
        others = others + F.exp(F.least(lead, F.lit(700.0)))
    return F.round(1 / (1 + others), 6)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Figures, votes, ``base_failed``, ``p_good`` and ``kept`` for each row.

    Features are computed once and written, small, to the shared folder: the model needs all votes before the first
    verdict.
    """
    prepare(docs.sparkSession)
    names = [f"vote_{r[0]}" for r in rules]
    rows = materialize(features(docs, id_col, text_col).select("*", *map(vote, rules)), "quality")
    counts = rows.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts), len(names))
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    good = p_good(model, names)
    return rows.withColumn("base_failed", failed).withColumn("p_good", good).withColumn("kept", ~failed & (good >= threshold))
