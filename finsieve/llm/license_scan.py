"""License scans: MinHash bands over overlapping text windows, verified by exact containment.

Everything is a DataFrame expression or join. Words are runs of letters and digits in
lower case; shingles are five words. Templates of up to ``n`` words (n = 8, 16, 32, ...) are
looked for in windows of 2n words that start every n words, so every occurrence lies
whole in some window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import let, store, table, text_or_empty

SHINGLE = 5
CONTAINED = 0.8
#: A window that holds the needed share of a template misses all bands with at most this
#: probability.
MISS = 1e-6
_NOT_WORD = "[^\\p{L}\\p{N}]+"


@dataclass(frozen=True)
class Template:
    license: str
    text: str


# Public license notices (fixed values).
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction",
    ),
    Template(
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    Template(
        "CC-BY-4.0",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ),
)


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def shingles_in(words: Column) -> Column:
    """Hashes of all runs of five words; none for shorter texts."""
    def hashes(all_words: Column) -> Column:
        starts = F.slice(all_words, 1, F.greatest(F.size(all_words) - (SHINGLE - 1), F.lit(0)))
        return F.transform(
            starts, lambda w, i: F.xxhash64(w, *[F.get(all_words, i + k) for k in range(1, SHINGLE)])
        )

    return let(words, hashes)


def plain_words(text: str) -> list[str]:
    """The words of a template, as :func:`words_in` cuts them (templates are plain ASCII)."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def window_class(n_words: int) -> int:
    """The smallest of 8, 16, 32, ... that is at least ``n_words``."""
    return max(8, 1 << (n_words - 1).bit_length())


def bands_for(n_words: int) -> int:
    """Bands (of one row) that find a template of ``n_words`` words but for ``MISS``.

    The window has 2n - 4 shingles; the needed share of the template's shingles is in it.
    """
    shingles = n_words - SHINGLE + 1
    needed = math.ceil(CONTAINED * shingles)
    likeness = needed / (2 * window_class(n_words) - SHINGLE + 1 + shingles - needed)
    return math.ceil(math.log(MISS) / math.log(1 - likeness))


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """template, license, words_class and shingles of every template of five or more words."""
    rows = [
        (i, t.license, window_class(len(w)), w)
        for i, t in enumerate(templates)
        if len(w := plain_words(t.text)) >= SHINGLE
    ]
    made = spark.createDataFrame(rows, "template int, license string, words_class int, words array<string>")
    return made.select("template", "license", "words_class", F.array_distinct(shingles_in(F.col("words"))).alias("shingles"))


def minhashes(shingles: Column, bands: int) -> Column:
    """One minimum per band, each over its own hash of the shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))),
    )


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Matches: doc_id, license, template, containment, first_word, n_windows.

    One row per id and template that has at least 80 % of its shingles in one window;
    first_word is where the first such window starts (counted in words), n_windows in how
    many windows it is found; rows with one id are one document.
    Null, empty and short texts match nothing. The template list is a parameter of fixed
    size, as are the tables made of it that are broadcast.
    """
    spark = docs.sparkSession
    made = template_table(spark, templates)
    known = made.select(F.explode("shingles").alias("h")).distinct()
    literal = F.array(*[F.lit(r.h) for r in known.collect()])  # a few hundred hashes of the templates
    bands: dict[int, int] = {}
    for t in templates:
        n = len(plain_words(t.text))
        if n >= SHINGLE:
            bands[window_class(n)] = max(bands.get(window_class(n), 0), bands_for(n))

    def windows(shingles: Column) -> Column:
        """All windows of all classes that share a shingle with a template: without one, a
        window can't share a minimum with a template either."""

        def of_class(size: int) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(size)),
                lambda at: F.struct(
                    F.lit(size).alias("words_class"), at.alias("first_word"),
                    F.slice(shingles, at + 1, F.lit(2 * size - SHINGLE + 1)).alias("inside"),
                ),
            )

        cut = F.concat(*[of_class(size) for size in sorted(bands)])
        near = F.filter(cut, lambda x: F.arrays_overlap(x["inside"], literal))
        return F.when((F.size(shingles) > 0) & F.arrays_overlap(shingles, literal), near)

    found = docs.select(
        F.col(id_column).alias("doc_id"),
        F.explode(let(shingles_in(words_in(text_or_empty(text_column))), windows)).alias("x"),
    )
    found = store(found.select("doc_id", "x.*"), "windows")
    matches = None
    for size, count in sorted(bands.items()):
        keyed = found.where(F.col("words_class") == size).select(
            "*", F.posexplode(minhashes(F.col("inside"), count)).alias("band", "least")
        )
        wanted = made.where(F.col("words_class") == size).select(
            "template", "license", "shingles", F.posexplode(minhashes(F.col("shingles"), count)).alias("band", "least")
        )
        share = F.size(F.array_intersect("inside", "shingles")) / F.size("shingles")
        same = (
            keyed.join(F.broadcast(wanted), ["band", "least"])
            .select("doc_id", "license", "template", "first_word", share.alias("containment"))
            .where(F.col("containment") >= CONTAINED)
        )
        matches = same if matches is None else matches.union(same)
    per_window = matches.groupBy("doc_id", "template", "license", "first_word").agg(F.max("containment").alias("containment"))
    return per_window.groupBy("doc_id", "license", "template").agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _template_sql() -> str:
    rows = []
    for i, t in enumerate(TEMPLATES):
        words = plain_words(t.text)
        shingles = sorted({" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)})
        rows += [f"({i}, '{t.license}', {window_class(len(words))}, {len(shingles)}, '{s}')" for s in shingles]
    return ", ".join(rows)


OP5_SQL = rf"""
WITH t(template, license, size, n, g) AS (VALUES {_template_sql()}),
d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, i AS p, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g, len(w) - 4 AS total
  FROM d, unnest(range(0, len(w) - 4)) AS r(i)
), hits AS (
  SELECT doc_id, template, license, size, n, s.g, p, o.k, (p // size - o.k) * size AS first_word
  FROM s JOIN t USING (g), range(0, 2) AS o(k)
), inside AS (
  SELECT doc_id, template, license, first_word, count(DISTINCT g) / n AS containment
  FROM hits WHERE first_word >= 0 AND p < first_word + 2 * size - 4
  GROUP BY doc_id, template, license, first_word, n
)
SELECT doc_id, license, template, max(containment) AS containment,
  min(first_word)::INTEGER AS first_word, count(*) AS n_windows
FROM inside WHERE containment >= 0.8 GROUP BY doc_id, license, template
"""
