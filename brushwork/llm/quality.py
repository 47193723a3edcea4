"""Quality rules: a table of thresholds over ratios of words, symbols, stop words and lines, compiled into projections.

Everything is a DataFrame expression over one row: no shuffle, no user function. Words are the runs of other than ASCII
white space, unchanged. Words repeated in 5-word windows are found by sorting a document's window hashes and comparing
neighbours, so the work of a document is n log n in its words.

Nulls: a null text has no words and fails the base rules; null ids and other columns are carried as they are. Ties do not
arise, as each row is judged alone, and repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import once
from .common import SPACE, table

WINDOW = 5

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "was", "by", "as", "are", "this", "from", "at", "or", "not",
    "der", "die", "das", "und", "ist", "nicht", "von", "den", "dem", "des", "zu", "mit", "sich", "auf", "ein", "eine", "im", "für",
    "le", "la", "les", "de", "du", "et", "un", "une", "en", "dans", "que", "qui", "pour", "par", "sur", "est", "pas", "avec", "au", "aux", "elle",
    "el", "los", "las", "del", "y", "por", "con", "para", "una", "se", "lo", "su", "al", "como", "más", "no",
)


class Rule(NamedTuple):
    """A document passes while low <= measure <= high, where the measure is a name of `measures`."""
    measure: str
    low: float | None = None
    high: float | None = None


# Production thresholds: those of published web filters, loosened where short clean texts would fall.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("letter_word_ratio", 0.7, None),
    Rule("stop_word_ratio", 0.02, None),
    Rule("capital_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: str, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(F.col(text), characters, ""))


def measured(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then `row_kept` as a struct of every count and ratio of a row under its own name."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = once(d, _words=F.filter(F.split("_text", SPACE), lambda w: w != ""),
             _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.get(F.col("_words"), i)
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    stops = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]
    d = once(
        d,
        _grams=F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(*[word(i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))),
        n_words=F.size("_words").cast("long"),
        word_chars=F.char_length(F.translate(F.col("_text"), " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=_removed("_text", SYMBOLS).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_stop=F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
        n_letter=F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
        n_capital=_removed("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        n_bullet=F.size(F.filter("_lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long"),
        n_ellipsis=F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long"),
    ).drop("_words", "_lines", "_text")
    twin = lambda g, k: (F.get(F.col("_grams"), k - 1)["h"] == g["h"]) | (F.get(F.col("_grams"), k + 1)["h"] == g["h"])
    d = once(d, _at=F.array_sort(F.transform(F.filter("_grams", lambda g, k: F.coalesce(twin(g, k), F.lit(False))), lambda g: g["i"]))).drop("_grams")
    new = F.transform("_at", lambda i, k: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("_at"), k + 1) - i), F.lit(WINDOW)))
    d = once(d, n_repeat_words=F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return d.select(
        "_own", *COUNTS,
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_letter") / words).alias("letter_word_ratio"),
        (F.col("n_stop") / words).alias("stop_word_ratio"),
        (F.col("n_capital") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_bullet") / lines).alias("bullet_line_ratio"),
        (F.col("n_ellipsis") / lines).alias("ellipsis_line_ratio"),
    )


def compiled(rules: Sequence[Rule]) -> Column:
    """The table of thresholds as one expression: the names of the rules that a row breaks."""
    broken = []
    for r in rules:
        m = F.col(r.measure)
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (m < r.low)
        if r.high is not None:
            outside = outside | (m > r.high)
        broken.append(F.when(outside, F.lit(r.measure)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: the columns `keep` in `_own`, all measures, base_failed, broken (names of broken rules) and kept."""
    return (measured(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("broken", compiled(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)))


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with all their columns."""
    return judged(docs, text, docs.columns, rules).where("kept").select(*[F.col("_own").getField(c).alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(F.col("_own.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in (*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]))

QUERIES = {
    "op5_quality_rules": (op5_quality_rules, rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
                   FROM documents),
        w AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM d WHERE len(words) >= 5),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n FROM w),
        r AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS covers FROM g WHERE n >= 2),
        s AS (SELECT doc_id, sum(covers) AS n_repeat_words FROM r GROUP BY doc_id),
        m AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                     greatest(len(lines), 1) AS n_lines, greatest(len(words), 1) AS n,
                     len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop,
                     len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_letter,
                     length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capital,
                     len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
                     len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
              FROM d LEFT JOIN s USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n BETWEEN 2 AND 12 AND n_symbols / n <= 0.1 AND n_letter / n >= 0.7 AND n_stop / n >= 0.02
               AND n_capital / greatest(word_chars, 1) <= 0.5 AND n_dup_lines / n_lines <= 0.3 AND n_bullet / n_lines <= 0.9
               AND n_ellipsis / n_lines <= 0.3 AS kept
        FROM b"""),
}
