"""Quality rules: a threshold table compiled into one Spark projection.

Metrics of length, symbols, stop words and lines are built-in functions over
the words and lines of a text; the table of rules becomes one array of the
names of the rules that fail. No user function, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 8

#: Frequent function words of the languages served (fixed values).
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are as with be at by this from or an have not he she they",
    "fr": "le la les de des du un une et est que qui en dans pour pas sur au avec ce il elle ne se plus par",
    "de": "der die das und ist von zu den mit ein eine im auf nicht sich des dem für als auch an es er sie",
    "es": "el la los las de que y en un una es por con no se su para al lo del como más o pero sus",
}


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``metric op threshold`` holds."""

    name: str
    metric: str
    op: str
    threshold: float


#: Rules of the contract: too few words, too many repeated ones.
BASE_RULES = (
    Rule("few_words", "n_words", "<", 20),
    Rule("repeated_words", "repeat_percent", ">", 30),
)
#: Rules of the method.
RULES = (
    Rule("short_words", "mean_word_chars", "<", 2),
    Rule("long_words", "mean_word_chars", ">", 14),
    Rule("symbols", "symbol_ratio", ">", 0.1),
    Rule("marks", "mark_ratio", ">", 0.5),
    Rule("few_stop_words", "stop_ratio", "<", 0.04),
    Rule("repeated_lines", "dup_line_ratio", ">", 0.4),
)


def fails(rule: Rule) -> Column:
    m, t = F.col(rule.metric), F.lit(rule.threshold)
    return {"<": m < t, "<=": m <= t, ">": m > t, ">=": m >= t}[rule.op]


def _shifted(c: str, by: int) -> Column:
    return F.slice(c, F.lit(by + 1), F.greatest(F.size(c) - F.lit(by), F.lit(0)))


def _repeat_steps(df: DataFrame, hashes: str) -> DataFrame:
    """Replace the word hashes by ``n_repeat_words``: words inside windows of 8
    words that occur twice or more.

    Windows are 64-bit hashes made by doubling (pairs, fours, eights). Only a
    text with two equal windows goes on to sort them: equal neighbours give the
    starts, and gaps between starts give the words covered. Every step is a
    column of its own, read more than once, so it is computed once per row.
    """
    rest = [c for c in df.columns if c != hashes]
    for name, prev, by in (("_h2", hashes, 1), ("_h4", "_h2", 2), ("_h8", "_h4", 4)):
        df = df.select(*rest, F.zip_with(F.col(prev), _shifted(prev, by), lambda a, b: F.xxhash64(a, b)).alias(name))
    df = df.select(*rest, F.slice("_h8", F.lit(1), F.greatest(F.size("_h8") - F.lit(WINDOW - 1), F.lit(0)))
                   .alias("_win"))
    df = df.select(*rest, F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    df = df.select(*rest, F.zip_with(
        F.col("_sorted"), _shifted("_sorted", 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))).alias("_pairs"))
    df = df.select(*rest, F.array_sort(F.array_distinct(F.flatten(
        F.filter("_pairs", lambda p: p.isNotNull())))).alias("_starts"))
    covered = F.aggregate(
        F.zip_with(F.col("_starts"), _shifted("_starts", 1),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return df.select(*rest, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of each text, one row per input row: the id, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and the
    ratios that the rules read (0 where a text has no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    marks = F.length("_text") - F.length(F.replace(F.replace("_text", F.lit("!")), F.lit("?")))
    df = df.select(
        "_id",
        F.array_remove(F.split("_text", r"[ \t\n\x0B\f\r]+"), "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("_lines"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        marks.cast("bigint").alias("n_marks"))
    stop = sorted({w for s in STOP_WORDS.values() for w in s.split()})
    df = df.select(
        "_id", "n_symbols", "n_marks",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("bigint").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"))
    df = _repeat_steps(df, "_h1")
    n = F.col("n_words")

    def ratio(c: Column) -> Column:
        return F.when(n > 0, c / n).otherwise(F.lit(0.0))

    return df.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio(F.lit(100) * F.col("n_repeat_words")).alias("repeat_percent"),
        ratio(F.col("word_chars")).alias("mean_word_chars"),
        ratio(F.col("n_symbols")).alias("symbol_ratio"),
        ratio(F.col("n_marks")).alias("mark_ratio"),
        ratio(F.col("n_stop_words")).alias("stop_ratio"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(F.lit(0.0))
        .alias("dup_line_ratio"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The metrics with ``failed`` (names of failing rules in table order),
    ``base_failed`` and ``kept``; one row per input row.

    A null or empty text has no words: it fails ``few_words``. A null id is
    kept; repeated rows give repeated results, an empty table an empty one;
    other columns are not read, whatever their names. A very long text is one
    row of arrays as long as its words. Two different windows are taken for
    equal with the odds of a 64-bit hash collision inside one text.
    """
    names = F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*base, *rules)])
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | fails(r)
    df = quality_metrics(docs, id_col, text_col)
    df = df.select("*", F.array_compact(names).alias("failed"), base_failed.alias("base_failed"))
    return df.withColumn("kept", F.size("failed") == 0)


def rules_sql(rules: tuple[Rule, ...]) -> str:
    """The same table as a SQL condition, for the oracle."""
    return " OR ".join(f"({r.metric} {r.op} {r.threshold!r})" for r in rules)
