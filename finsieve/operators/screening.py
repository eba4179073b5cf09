"""Name screening against watchlists without comparing every name with every entry.

Names are normalised and reduced to distinct ones first. Pairs that can reach the
threshold come from four equi-joins, each exact for its rule: an equal or shorter
name equals a piece of the entry; an entry inside a longer name shares the entry's
rarest character triple; enough common words means a common rare word. Only those
candidates are scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S

_GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.filter(pieces, lambda p: F.length(p) == size))


def _pieces(text: Column) -> Column:
    """All distinct non-empty substrings (entries are names, so these stay short)."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    cut = F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))),
            lambda k: F.substring(text, i, k),
        ),
    )
    return F.array_distinct(F.filter(F.flatten(cut), lambda p: p != ""))


def _entry_inside_name(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs where the entry is part of the name."""
    size = F.least(F.length("entry"), F.lit(_GRAM))
    # At most three lengths exist.
    sizes = [r[0] for r in entries.where("entry != ''").select(size).distinct().collect()]
    found = []
    for n in sorted(sizes):
        of_size = entries.where((size == n) & (F.col("entry") != ""))
        grams = of_size.select("entry", F.explode(_grams(F.col("entry"), n)).alias("gram"))
        mine = names.select("name", F.explode(_grams(F.col("name"), n)).alias("gram"))
        wanted = mine.join(grams.select("gram").distinct(), "gram", "left_semi")
        common = wanted.groupBy("gram").agg(F.count("*").alias("n"))
        # Each entry is looked up under the triple that the fewest names have. A
        # triple that no name has rules the entry out.
        rarest = (
            grams.join(common, "gram", "left")
            .groupBy("entry")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"]
                 .alias("gram"))
        )
        found.append(
            mine.join(rarest, "gram").where(F.contains("name", F.col("entry")))
            .select("name", "entry")
        )
    if not found:
        return names.join(entries, F.lit(False)).select("name", "entry")
    return reduce(DataFrame.unionByName, found)


def _name_inside_entry(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs where the name is part of the entry (or equal to it)."""
    pieces = entries.select("entry", F.explode(_pieces(F.col("entry"))).alias("name"))
    return names.join(pieces, "name").select("name", "entry")


def _common_words(names: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs sharing a word of both prefixes.

    With words ordered by how many entries use them, two word sets that overlap by the
    threshold share a word among the first n - ceil(threshold * n) + 1 of each.
    """
    share = threshold / 100.0
    used = (
        entries.select(F.explode(S.name_words(F.col("entry"))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("uses"))
    )

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        words = df.select(
            name, F.explode(S.name_words(F.col(name))).alias("word")
        ).join(used, "word", "left")
        ranked = words.groupBy(name).agg(
            F.sort_array(
                F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))
            ).alias("words")
        )
        n = F.size("words")
        keep = (n - F.ceil(n * share - F.lit(1e-9)) + 1).cast("int")
        return ranked.select(name, F.explode(F.slice("words", F.lit(1), keep)).alias("w")).select(
            name, "w.word"
        )

    pairs = prefixes(names, "name").join(prefixes(entries, "entry"), "word")
    return pairs.select("name", "entry")


def similar_names(
    names: DataFrame, entries: DataFrame, threshold: float = 70.0, strict: bool = False
) -> DataFrame:
    """``name, entry, score`` for distinct normalised names that score at least
    ``threshold``. An empty name is part of every entry (90) unless ``strict``."""
    names = names.select("name").distinct()
    entries = entries.select("entry").distinct()
    parts = [
        _name_inside_entry(names, entries),
        _entry_inside_name(names, entries),
        _common_words(names, entries, threshold),
    ]
    if not strict:
        # One distinct empty string on one side each.
        empty_name = names.where("name = ''")
        empty_entry = entries.where("entry = ''")
        parts += [empty_name.crossJoin(entries), names.crossJoin(empty_entry)]
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    scored = pairs.withColumn("score", S.name_similarity(F.col("name"), F.col("entry")))
    return scored.where(F.col("score") >= threshold)


def _with_normal(people: DataFrame) -> DataFrame:
    return people.withColumn("_norm", S.normal_name(F.coalesce("full_name", F.lit(""))))


def screen_pep(
    people: DataFrame, watchlist: DataFrame, threshold: float = 70.0,
    include_inactive: bool = True, match_country: bool = False, strict: bool = False,
) -> DataFrame:
    """Matches of ``customer_id, full_name[, country]`` with exposed persons.

    ``watchlist`` has ``name, level, position, country, active``.
    """
    entries = watchlist.withColumn("_entry", S.normal_name(F.col("name")))
    if not include_inactive:
        entries = entries.where(F.coalesce("active", F.lit(True)))
    named = _with_normal(people)
    pairs = similar_names(
        named.select(F.col("_norm").alias("name")),
        entries.select(F.col("_entry").alias("entry")), threshold, strict,
    ).withColumnsRenamed({"name": "_norm", "entry": "_entry"})
    listed = pairs.join(
        entries.select("_entry", F.col("name").alias("matched_name"), "level", "position",
                       F.col("country").alias("matched_country"), "active"),
        "_entry",
    )
    matches = named.join(listed, "_norm")
    if match_country:
        same = F.lower(F.coalesce("matched_country", F.lit(""))) == F.lower("country")
        matches = matches.where((F.length(F.coalesce("country", F.lit(""))) == 0) | same)
    kind = (
        F.when(F.col("score") >= 95, vocab.MATCH_EXACT)
        .when(F.col("score") >= 85, vocab.MATCH_PARTIAL).otherwise(vocab.MATCH_FUZZY)
    )
    return matches.select(
        "customer_id", "full_name", S.stable_id("PEP", F.col("matched_name")).alias("match_id"),
        "matched_name", kind.alias("match_type"), F.col("score").alias("match_score"),
        F.lit("PEP").alias("screening_type"), "level", "position",
        F.col("matched_country").alias("country"), "active",
    )


def screen_sanctions(
    people: DataFrame, watchlist: DataFrame, threshold: float = 70.0,
    lists: list[str] | None = None, check_aliases: bool = True, strict: bool = False,
) -> DataFrame:
    """Matches with sanctioned entities; per entity the first of name and aliases counts.

    ``watchlist`` has ``name, list, reason, country, aliases``.
    """
    scope = watchlist if lists is None else watchlist.where(F.col("list").isin(*lists))
    spellings = F.array("name")
    if check_aliases:
        none = F.array().cast("array<string>")
        spellings = F.concat(spellings, F.coalesce("aliases", none))
    entries = scope.select(
        F.col("name").alias("matched_name"), "list", "reason", "country",
        F.posexplode(spellings).alias("pos", "spelling"),
    ).withColumn("_entry", S.normal_name(F.col("spelling")))
    named = _with_normal(people)
    pairs = similar_names(
        named.select(F.col("_norm").alias("name")),
        entries.select(F.col("_entry").alias("entry")), threshold, strict,
    ).withColumnsRenamed({"name": "_norm", "entry": "_entry"})
    # Decide per distinct name and entity, before any customer is joined.
    first = F.min(F.struct("pos", "score", "spelling", "list", "reason", "country"))
    decided = pairs.join(entries, "_entry").groupBy("_norm", "matched_name").agg(
        first.alias("m")
    )
    alias = F.col("m.spelling") != F.col("matched_name")
    kind = (
        F.when(F.col("m.score") >= 95, vocab.MATCH_EXACT).when(alias, vocab.MATCH_ALIAS)
        .when(F.col("m.score") >= 85, vocab.MATCH_PARTIAL).otherwise(vocab.MATCH_FUZZY)
    )
    return named.join(decided, "_norm").select(
        "customer_id", "full_name", S.stable_id("SAN", F.col("matched_name")).alias("match_id"),
        "matched_name", kind.alias("match_type"), F.col("m.score").alias("match_score"),
        F.lit("SANCTIONS").alias("screening_type"), "m.list", "m.reason", "m.country",
        F.when(alias, F.col("m.spelling")).alias("matched_alias"),
    )


def pep_results(people: DataFrame, matches: DataFrame) -> DataFrame:
    """Risk per person: best score, half as much again for a high level, at most 100."""
    high = F.col("level").contains("YUKSEK") | F.col("level").contains("HIGH")
    found = matches.groupBy("customer_id").agg(
        F.count("*").alias("matches"), F.max("match_score").alias("best"),
        F.max(F.coalesce(high, F.lit(False))).alias("high"),
    )
    risk = F.least(
        F.lit(100.0), F.col("best") * F.when(F.col("high"), 1.5).otherwise(1.0)
    )
    return _results(people, found, risk, vocab.SCREEN_PEP, vocab.SCREEN_NO_PEP)


def sanction_results(people: DataFrame, matches: DataFrame) -> DataFrame:
    found = matches.groupBy("customer_id").agg(F.count("*").alias("matches"))
    return _results(
        people, found, F.lit(100.0), vocab.SCREEN_SANCTION, vocab.SCREEN_NO_SANCTION
    )


def _results(
    people: DataFrame, found: DataFrame, risk: Column, hit: str, clean: str
) -> DataFrame:
    any_match = F.col("matches").isNotNull()
    return people.select("customer_id").join(found, "customer_id", "left").select(
        "customer_id",
        F.coalesce("matches", F.lit(0).cast("long")).alias("matches"),
        F.when(any_match, risk).otherwise(0.0).alias("risk_score"),
        F.when(any_match, F.lit(hit)).otherwise(F.lit(clean)).alias("recommendation"),
    )


def screen_full(pep: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Both results per person: all matches, the higher risk, the stricter advice."""
    both = pep.select(
        "customer_id", F.col("matches").alias("pep"), F.lit(0).cast("long").alias("san"),
        "risk_score",
    ).unionByName(
        sanctions.select(
            "customer_id", F.lit(0).cast("long").alias("pep"), F.col("matches").alias("san"),
            "risk_score",
        )
    ).groupBy("customer_id").agg(
        F.max("pep").alias("pep"), F.max("san").alias("san"),
        F.max("risk_score").alias("risk_score"),
    )
    advice = (
        F.when(F.col("san") > 0, vocab.SCREEN_FULL_SANCTION)
        .when(F.col("pep") > 0, vocab.SCREEN_PEP).otherwise(vocab.SCREEN_CLEAN)
    )
    return both.select(
        "customer_id", (F.col("pep") + F.col("san")).alias("matches"), "risk_score",
        advice.alias("recommendation"),
    )


def adverse_media(
    texts: DataFrame, words: tuple[str, ...] = vocab.ADVERSE_MEDIA_KEYWORDS
) -> DataFrame:
    """Whole texts that contain adverse-media words, with the words."""
    found = S.found_keywords(F.col("text"), words)
    return texts.withColumn("keywords", found).where(F.size("keywords") > 0)
