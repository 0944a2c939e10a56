"""Quality verdicts by weak supervision.

Rules look at counts of a document and vote good (1), bad (-1) or abstain (0). No
rule decides alone: expectation-maximisation over how often each pattern of votes
occurs estimates how accurate each rule is, without labels, and a document is kept
when the posterior probability that it is good reaches one half. The patterns are
few (3 to the number of rules at most), so only their counts reach the driver, while
the counts cover all documents.

Defined cases: a null or empty text has no words and all counts 0; it fails the
base rules. Repeated rows are judged each for itself, and all count in the corpus.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKED = r"[.,](?![^\x20\x09-\x0D])"  # a word's last sign


def counted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and its counts, by array functions within the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = documents.select(F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_w", F.split("_t", WHITE))
    outer_white = (F.get("_w", F.lit(0)) == "") | (F.element_at("_w", -1) == "")
    rows = rows.select("_id", "_t", F.when(outer_white, F.filter("_w", lambda x: x != "")).otherwise(F.col("_w")).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    # A window's hash: two windows of one text share it by chance in about 1 of 2**64 cases.
    windows = F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    windows = F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0)))
    rows = rows.select(
        "_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit(MARKED)).cast("long").alias("n_marked"),
        windows.alias("_h"),
    )
    rows = rows.withColumn("_g", F.sort_array("_h"))
    rows = rows.withColumn("_d", F.array_distinct(F.filter("_g", lambda x, i: x == F.get("_g", i - 1)))).drop("_g")
    # Where few windows repeat, looking them up beats sorting all windows with their places.
    few = F.size("_d") <= 24
    rows = rows.withColumn("_p", F.when(~few, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get("_p", i)["h"]
    looked_up = F.when(F.size("_d") > 0, F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)))
    paired = F.transform("_p", lambda x, i: F.when((x["h"] == at(i - 1)) | (x["h"] == at(i + 1)), x["i"]))
    rows = rows.withColumn("_s", F.sort_array(F.filter(F.when(few, looked_up).otherwise(paired), lambda x: x.isNotNull()))).drop("_p", "_h", "_d")
    # A repeated window covers its three words, or those up to where the next one starts.
    covered = F.aggregate(
        F.transform("_s", lambda x, i: F.coalesce(F.least(F.lit(3), F.get("_s", i + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_s").withColumnRenamed("_id", id_col)


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``counted``; integers only, so that they vote alike everywhere.

    Rules against a document abstain where they don't fire; rules for it ask for
    several signs of prose at once.
    """
    c = F.col
    n = c("n_words")
    plain = 100 * c("n_symbols") <= n
    against = lambda sign: F.when(sign, -1).otherwise(0)
    return {
        "symbols": against(10 * c("n_symbols") > n),
        "lines": against(5 * c("n_dup_lines") > c("n_lines")),
        "repeats": against(5 * c("n_repeat_words") > n),
        "word_length": against((c("word_chars") < 3 * n) | (c("word_chars") > 9 * n)),
        "variety": against(5 * c("n_distinct") < 2 * n),
        "marks": against((50 * c("n_marked") < n) | (2 * c("n_marked") > n)),
        "prose": F.when(plain & (20 * c("n_marked") >= n) & (3 * c("n_marked") <= n) & (c("word_chars") >= 4 * n) & (2 * c("word_chars") <= 13 * n), 1).otherwise(0),
        "varied": F.when(plain & (2 * c("n_distinct") > n) & (20 * c("n_repeat_words") < n) & (5 * c("n_dup_lines") <= c("n_lines")), 1).otherwise(0),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimate(patterns: dict[tuple[int, ...], int], prior: float = 0.5, rounds: int = 200, sure: tuple[float, float] = (8.0, 2.0)) -> tuple[float, ...]:
    """Accuracy of each rule by expectation-maximisation over vote patterns.

    A rule is right or wrong where it votes; where it abstains it says nothing.
    ``prior`` is the share of good documents to assume without votes, ``sure`` the
    votes right and wrong that each rule is credited with beforehand.
    """
    if not patterns:
        return ()
    rules = range(len(next(iter(patterns))))
    accuracy = tuple(sure[0] / sum(sure) for _ in rules)
    for _ in range(rounds):
        belief = {p: 1 / (1 + math.exp(-log_odds(p, accuracy, prior))) for p in patterns}
        after = []
        for j in rules:
            right = sum(c * (belief[p] if p[j] > 0 else 1 - belief[p]) for p, c in patterns.items() if p[j])
            cast = sum(c for p, c in patterns.items() if p[j])
            after.append(min(max((right + sure[0]) / (cast + sum(sure)), 0.05), 0.995))
        moved = max(abs(x - y) for x, y in zip(after, accuracy, strict=True))
        accuracy = tuple(after)
        if moved < 1e-12:
            break
    return accuracy


def log_odds(pattern: tuple[int, ...], accuracy: tuple[float, ...], prior: float = 0.5) -> float:
    return math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy, strict=True))


def posterior(accuracy: tuple[float, ...], ballot: list[Column], prior: float = 0.5) -> Column:
    """Probability that a document is good, from its votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for a, vote in zip(accuracy, ballot, strict=False):
        odds = odds + vote * F.lit(math.log(a / (1 - a)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its counts, base_failed, p_good and kept."""
    counts = materialize(counted(documents, id_col, text_col), "quality")
    rules = votes()
    patterns = counts.groupBy(*(v.alias(f"v{j}") for j, v in enumerate(rules.values()))).count().collect()  # 3**8 rows at most
    found = estimate({tuple(r[f"v{j}"] for j in range(len(rules))): r["count"] for r in patterns})
    judged = counts.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(found, list(rules.values())))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good"
    )
