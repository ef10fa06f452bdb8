"""Quality rules as a short-circuit cascade: cheap rules that reject much come first. DataFrame functions only.

Every text gets its counts (features). A bounded sample of texts then tells how long each rule takes
and how many rows it rejects; rules are tried in the order of rejection per cost, and a row that one
rule rejects is not shown to the next (a CASE expression evaluates its branches lazily). The order
decides the time alone: a row is kept if and only if no rule rejects it, whatever the order.

Null and empty texts have no words and all counts 0. Texts are read whole; the work on a text is
n log n in its words. Windows of words are compared by 64-bit hashes inside one text. Rows stand
alone, so repeated rows get the same counts; an empty table gives an empty one. Columns of the table
with the names of the counts are replaced; all others stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOL = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Rows of the sample that sets the order of the rules, and the longest text in it (characters); results don't depend on it.
SAMPLE_ROWS, SAMPLE_CHARS = 512, 1 << 15


@dataclass(frozen=True)
class Rule:
    """A name and a condition over COUNTS, _words and _lines that is true for rows to be rejected."""

    name: str
    rejects: Callable[[], Column]


def _share(words: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(words, test))


def _shouted(w: Column) -> Column:
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")


#: Shares are of words, or of lines that have a word.
RULES = [
    Rule("symbols", lambda: F.col("n_symbols") * 4 > F.col("n_words")),
    Rule("word_length", lambda: ~F.col("word_chars").between(F.col("n_words") * 2, F.col("n_words") * 20)),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
    Rule("bullets", lambda: _share("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•‣][\x20\x09]")) * 10 > F.col("n_lines") * 9),
    Rule("ellipses", lambda: _share("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")) * 10 > F.col("n_lines") * 3),
    Rule("letters", lambda: _share("_words", lambda w: w.rlike(r"\p{L}")) * 10 < F.col("n_words") * 6),
    Rule("shouting", lambda: _share("_words", _shouted) * 10 > F.col("n_words") * 4),
    Rule("few_words", lambda: F.size(F.array_distinct("_words")) * 50 < F.least(F.col("n_words"), F.lit(1000))),
]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS (long), and with _words and _lines for the rules."""
    df = df.drop(*COUNTS).withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    # single words by index: slice() copies the whole array each time
    df = df.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_order", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("_windows")
    alike = lambda a, b: F.get(F.col("_order"), a)["h"] == F.get(F.col("_order"), b)["h"]
    found = F.transform("_order", lambda x, k: F.when(F.coalesce(alike(k, k - 1), F.lit(False)) | F.coalesce(alike(k, k + 1), F.lit(False)), x["i"]))
    df = df.withColumn("_found", F.sort_array(F.array_compact(found))).drop("_order")
    covered = F.aggregate(
        "_found", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )
    counts = {
        "n_words": n, "word_chars": F.char_length(F.array_join("_words", "")), "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": covered,
    }
    counted = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    # rows of a generator: a filter on a count is not pushed below, where it would compute everything again for each use of a column
    return df.select(*[c for c in df.columns if c not in ("_text", "_found")], F.inline(F.array(counted)))


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30% of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measured(sample: DataFrame, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share of rows that it rejects) over sample, which has features(); each rule runs alone, twice."""

    def run(rejects: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        n, hit = sample.agg(F.count(F.lit(1)), F.count_if(rejects)).first()
        return time.perf_counter() - began, n, hit

    empty = min(run(F.col("n_words") < 0)[0] for _ in range(2))
    out = []
    for r in rules:
        seconds, n, hit = min(run(r.rejects()) for _ in range(2))
        out.append((r.name, max(seconds - empty, 0.0) / max(n, 1), hit / max(n, 1)))
    return out


def ordered(rules: list[Rule], figures: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, the best first; equal ones keep their order."""
    worth = {name: share / max(seconds, 1e-9) for name, seconds, share in figures}
    return sorted(rules, key=lambda r: -worth[r.name])


def rule_order(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> list[Rule]:
    """rules in the order that a sample of df suggests: SAMPLE_ROWS rows at most, taken from as few of its partitions as hold them.

    Rows that fail the base rules never reach the cascade, so they don't count; without rows the order stays.
    """
    rows = df.select(F.col(text).cast("string").alias("text")).where(F.char_length("text") <= SAMPLE_CHARS).take(SAMPLE_ROWS)
    sample = features(df.sparkSession.createDataFrame(rows, "text string")).drop("text").cache()
    reached = sample.where(~base_failed())
    try:
        return ordered(rules, measured(reached, rules)) if reached.count() else list(rules)
    finally:
        sample.unpersist()


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """df with COUNTS, base_failed, kept, and rejected_by: the first rule of the cascade that rejects the row (base, or a name).

    rules are tried in the given order; without them RULES in the order of rule_order().
    """
    rules = rule_order(df, text) if rules is None else rules
    df = features(df.drop("base_failed", "kept", "rejected_by"), text).withColumn("base_failed", base_failed())
    by = F.when(F.col("base_failed"), "base")
    for r in rules:
        by = by.when(r.rejects(), r.name)
    df = df.withColumn("rejected_by", by).drop("_words", "_lines")
    return df.withColumn("kept", F.col("rejected_by").isNull())
