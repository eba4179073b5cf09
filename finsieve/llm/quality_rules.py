"""Quality rules: a threshold table compiled into one projection of JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import free_name, let, table, text_or_empty, words_of

WINDOW = 5

# The commonest words of English, German, French and Spanish, as they stand in running text.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this from at not have or an "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par sur au avec pas ce il "
    "el los y las se del por con una su para como más lo al o"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [least, most]; it counts for texts of so many words and lines."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0
    from_lines: int = 0


#: The production table. Ratios of short texts scatter, so some rules wait for enough words.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0, from_words=20),
    Rule("symbols", "symbols_per_word", most=0.2),
    Rule("stop_words", "stop_word_ratio", least=0.04, from_words=60),
    Rule("repeated_lines", "dup_line_ratio", most=0.3, from_lines=10),
)


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside ``size``-word windows that the text has twice or more."""
    spots = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    hashes = F.transform(
        spots, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)])
    )

    def covered(h: Column) -> Column:
        # Sorted by hash and then by the words themselves, equal windows are neighbours.
        entries = F.sort_array(
            F.transform(
                h, lambda x, i: F.struct(x.alias("h"), F.slice(words, i + 1, size).alias("w"), i.alias("i"))
            )
        )

        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

        def starts(s: Column) -> Column:
            found = F.transform(
                s,
                lambda x, k: F.when(
                    same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)), x["i"]
                ),
            )
            return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

        return let(
            let(entries, starts),
            lambda p: F.aggregate(
                F.transform(
                    p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(size)), F.lit(size))
                ),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    # Windows with all different hashes are all different; only other texts are sorted.
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            covered(h)
        ),
    )


def measure(docs: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the struct column ``measures``; nothing leaves its row, nothing is shuffled.

    A null or blank text has no words: all its counts and ratios are 0. A column ``measures``
    that ``docs`` has already is replaced, every other column stays.
    """
    words, kept_lines = free_name(docs, "words_"), free_name(docs, "lines_")
    text = text_or_empty(text_column)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    wide = docs.withColumns({words: words_of(text), kept_lines: lines})
    n = F.size(words).cast("long")
    n_lines = F.size(kept_lines).cast("long")
    counted = wide.withColumn(
        "measures",
        F.struct(
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            n_lines.alias("n_lines"),
            (n_lines - F.size(F.array_distinct(kept_lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(F.col(words), window).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        ),
    )
    return counted.drop(words, kept_lines)


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules may name."""
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_word_ratio": m["n_stop_words"] / words,
        "dup_line_ratio": m["n_dup_lines"] / lines,
        "repeat_word_ratio": m["n_repeat_words"] / words,
    }


def compiled(rules: Sequence[Rule], m: Column) -> Column:
    """The names of the rules that a row breaks, as one array expression."""
    values = ratios(m)
    broken = []
    for rule in rules:
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (values[rule.measure] < rule.least)
        if rule.most is not None:
            outside = outside | (values[rule.measure] > rule.most)
        enough = (m["n_words"] >= rule.from_words) & (m["n_lines"] >= rule.from_lines)
        broken.append(F.when(outside & enough, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text") -> DataFrame:
    """``docs`` with ``measures``, ``broken_rules``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words repeat. A column of
    ``docs`` with one of these four names is replaced.
    """
    m = F.col("measures")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    out = measure(docs, text_column).withColumns(
        {"broken_rules": compiled(rules, m), "base_failed": failed}
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id",
        *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")],
        "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"),
    )


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    array_to_string(list_filter([
      CASE WHEN n_words >= 20 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0) THEN 'word_length' END,
      CASE WHEN n_symbols / greatest(n_words, 1) > 0.2 THEN 'symbols' END,
      CASE WHEN n_words >= 60 AND n_stop_words / n_words < 0.04 THEN 'stop_words' END,
      CASE WHEN n_lines >= 10 AND n_dup_lines / greatest(n_lines, 1) > 0.3 THEN 'repeated_lines' END
    ], lambda x: x IS NOT NULL), ',') AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
  base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM b
"""
