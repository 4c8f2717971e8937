"""Quality by weak supervision: rules vote or abstain, and their votes are weighed by estimated accuracies.

Each rule says good (1), bad (-1) or nothing (0) about a document. The model: a document is good with
probability ``prior``; a rule that speaks is right about good documents with one accuracy and about bad
ones with another, apart from other rules (a rule that knows one kind of junk is nearly always right about
good documents and seldom about bad ones). All are estimated by expectation-maximisation. Votes are counted
by pattern (3**rules patterns at most, so a corpus of any size is a table of fixed size), and the rounds run
over those counts. Estimates stay within the bounds below, so a bad vote can't turn into praise and no rule
is beyond doubt. Everything that touches rows is DataFrame operations.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import SEPARATORS, written

MOST_PATTERNS = 3**10
#: Start and bounds of the estimates: documents that are good, good ones called good, bad ones called bad.
START = {"prior": (0.85, 0.5, 0.98), "on_good": (0.995, 0.9, 0.999), "on_bad": (0.2, 0.1, 0.9)}


def _measured(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` with the counts of whole texts. Each select stage binds what the next uses more than once."""
    pieces = F.split(F.col("_text"), SEPARATORS)
    lone = lambda at: (F.element_at("_words", at) == "").cast("int")  # noqa: E731  only the ends of a split can be empty
    df = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text")).select(*keep, "_text", pieces.alias("_words"))
    first, size = lone(1), F.size("_words") - lone(1) - lone(-1)
    df = df.select(*keep, "_text", F.slice(F.col("_words"), first + 1, F.greatest(size, F.lit(0))).alias("_words"))

    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    triple = F.transform(
        F.sequence(F.lit(1), F.size("_words") - 2),
        lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
    )
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_words") > 2, triple).alias("_triples"),
        F.regexp_count("_text", F.lit(r"[.!?。！？][\"'”’)\]]*[\x20\x09-\x0D]*(?:\n|\z)")).cast("long").alias("n_ends"),
        F.regexp_count("_text", F.lit(r"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0DA-Za-zÀ-￿]+(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_bare"),
    )
    # windows with their places, sorted: equal ones are neighbours
    places = F.sequence(F.lit(0), F.size("_triples") - 1)
    pairs = F.sort_array(F.arrays_zip(F.col("_triples").alias("h"), places.alias("i")))
    repeats = F.size(F.array_distinct("_triples")) < F.size("_triples")
    df = df.select(
        *[c for c in df.columns if c not in ("_lines", "_triples")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, pairs).alias("_pairs"),
    )
    beside = lambda x, k: (
        (x["h"] == F.get("_pairs", k - 1)["h"]) | (x["h"] == F.get("_pairs", k + 1)["h"])
    )
    twice = F.filter("_pairs", lambda x, k: F.coalesce(beside(x, k), F.lit(False)))
    df = df.select(*[c for c in df.columns if c != "_pairs"], F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_at"))
    # windows three words wide: each adds its words up to where the next one starts
    covered = F.aggregate(
        F.transform("_at", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - at, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return df.select(*[c for c in df.columns if c != "_at"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rule_votes() -> dict[str, Column]:
    """The rules over measured documents. Each abstains between its two bounds."""
    n, lines = F.col("n_words"), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.col("word_chars") / F.greatest(n, F.lit(1))
    return {
        "word_length": _vote(chars.between(3, 10), (chars < 2) | (chars > 14)),
        "symbols": _vote(F.col("n_symbols") <= 0.02 * n, F.col("n_symbols") > 0.1 * n),
        "dup_lines": _vote(F.col("n_dup_lines") <= 0.05 * lines, (F.col("n_dup_lines") > 0.3 * lines) & (F.col("n_dup_lines") > 2)),
        "repeats": _vote(F.col("n_repeat_words") <= 0.1 * n, F.col("n_repeat_words") > 0.3 * n),
        "line_ends": _vote(F.col("n_ends") >= 0.6 * lines, F.col("n_ends") < 0.1 * lines),
        "letters": _vote(F.col("n_bare") <= 0.1 * n, F.col("n_bare") > 0.4 * n),
    }


def _odds(prior: float, on_good: list[float], on_bad: list[float]) -> list[float]:
    """Log odds of good: of the prior, and of each rule's good and bad vote."""
    return [log(prior / (1 - prior))] + [log(g / (1 - b)) for g, b in zip(on_good, on_bad, strict=True)] + [log((1 - g) / b) for g, b in zip(on_good, on_bad, strict=True)]


def _posterior(rules: list[str], odds: list[Column]) -> Column:
    """Probability of good: the log odds of the prior and of each vote, added."""
    score = odds[0]
    for i, name in enumerate(rules, 1):
        score = score + F.when(F.col(name) == 1, odds[i]).when(F.col(name) == -1, odds[i + len(rules)]).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def fit(votes: DataFrame, rules: list[str], rounds: int = 30, settled: float = 1e-4) -> tuple[float, list[float], list[float]]:
    """The prior and each rule's accuracy on good and on bad documents, from ``votes`` with -1, 0 or 1 for each rule.

    Votes are counted by pattern; the rounds run over those counts, 3**rules rows at most whatever the
    corpus. Stops after ``rounds`` or when nothing moves by ``settled``. With no rows it returns the start; a
    rule that never speaks keeps its start.
    """
    if 3 ** len(rules) > MOST_PATTERNS:
        raise ValueError("too many rules for one table of patterns")
    counts = votes.groupBy(*rules).agg(F.count("*").alias("_n")).orderBy(*rules).collect()
    m = len(rules)
    kinds = ["prior"] + ["on_good"] * m + ["on_bad"] * m
    estimate = [START[kind][0] for kind in kinds]
    for _ in range(rounds):
        odds = _odds(estimate[0], estimate[1 : m + 1], estimate[m + 1 :])
        right, asked = [0.0] * len(kinds), [0.0] * len(kinds)
        for *vote, n in counts:
            score = odds[0] + sum(odds[i + 1] if v == 1 else odds[i + 1 + m] for i, v in enumerate(vote) if v)
            good = n / (1 + exp(-score))
            right[0], asked[0] = right[0] + good, asked[0] + n
            for i, v in enumerate(vote, 1):
                if v:
                    right[i], asked[i] = right[i] + good * (v == 1), asked[i] + good
                    right[i + m], asked[i + m] = right[i + m] + (n - good) * (v == -1), asked[i + m] + n - good
        new = [
            min(max(r / a, START[kind][1]), START[kind][2]) if a > 0 else old
            for r, a, kind, old in zip(right, asked, kinds, estimate, strict=True)
        ]
        moved, estimate = max(abs(x - y) for x, y in zip(new, estimate, strict=True)), new
        if moved < settled:
            break
    return estimate[0], estimate[1 : m + 1], estimate[m + 1 :]


def judge(docs: DataFrame, threshold: float = 0.8, least_words: int = 50, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, the counts, each rule's vote, ``base_failed``, ``quality`` (the posterior) and ``kept``.

    A text fails the base with fewer than ``least_words`` words or over half its words in repeated 3-word
    windows; else it is kept if its posterior reaches ``threshold``. Null and empty texts have no words and
    fail. Repeated rows are judged apart and alike; other columns are ignored; no rows give no rows.
    """
    measured = written(_measured(docs, F.col(text_col).cast("string"), list(keep)), "quality")
    rules = rule_votes()
    voted = measured.withColumns(rules)
    model = fit(voted, list(rules))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "*", failed.alias("base_failed"), _posterior(list(rules), [F.lit(x) for x in _odds(*model)]).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def good_documents(docs: DataFrame, threshold: float = 0.8, least_words: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are.

    Texts are counted once: each row is written with its votes (a byte for each rule), the model is fitted on
    all votes, and a second pass over that table keeps or drops each row. Texts aren't shuffled, and the names
    of other columns don't matter.
    """
    rules = list(rule_votes())
    text = F.col(text_col).cast("string")
    rows = _measured(docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_in")), F.col("_in"), ["_row"])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = written(rows.withColumns(rule_votes()).select("_row", failed.alias("_failed"), *rules), "votes")
    good = _posterior(rules, [F.lit(x) for x in _odds(*fit(voted, rules))]) >= threshold
    return voted.where(~F.col("_failed") & good).select("_row.*")
