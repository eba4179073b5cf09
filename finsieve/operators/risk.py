"""Customer risk scoring and due diligence as expressions over profile rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions.scalars import lookup, strip
from finsieve.operators.alerts import _breakdown
from finsieve.operators.ordering import top_structs

FACTORS = tuple(vocab.RISK_WEIGHTS)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _score(table: Mapping[str, int], value: Column) -> Column:
    return F.try_element_at(lookup({k: float(v) for k, v in table.items()}), value)


def _listed(
    table: Mapping[str, int], value: Column, both_ways: bool, strict: bool
) -> Column:
    """Exact score, else 0.8 of the first listed entry contained, else 2."""
    low = F.lower(value)
    partial = F.lit(None).cast("double")
    for name, points in reversed(list(table.items())):
        entry = F.lower(F.lit(name))
        hit = F.contains(low, entry)
        if both_ways:
            hit |= F.contains(entry, low)
        partial = F.when(hit, F.lit(points * 0.8)).otherwise(partial)
    if strict:
        partial = F.when(F.length(strip(value)) > 0, partial)
    return F.coalesce(_score(table, value), partial, F.lit(2.0))


def country_factor() -> Column:
    """Nationality from both lists, residence from the high-risk list only."""
    nation, home = _text("nationality"), _text("country_of_residence")
    return F.greatest(
        F.coalesce(
            _score(vocab.HIGH_RISK_COUNTRIES, nation),
            _score(vocab.MEDIUM_RISK_COUNTRIES, nation), F.lit(0.0),
        ),
        F.coalesce(_score(vocab.HIGH_RISK_COUNTRIES, home), F.lit(0.0)),
    )


def occupation_factor(strict: bool = False) -> Column:
    return _listed(vocab.HIGH_RISK_OCCUPATIONS, _text("occupation"), True, strict)


def business_factor() -> Column:
    listed = _listed(vocab.HIGH_RISK_BUSINESS_TYPES, _text("business_type"), False, False)
    return F.when(F.col("customer_type") == vocab.INDIVIDUAL, 0.0).otherwise(listed)


def volume_factor() -> Column:
    income = F.coalesce("declared_monthly_income", F.lit(0.0))
    ratio = F.coalesce("monthly_transaction_volume", F.lit(0.0)) / F.nullif(income, F.lit(0.0))
    return (
        F.when(income <= 0, 5.0).when(ratio > 5, 8.0).when(ratio > 3, 6.0)
        .when(ratio > 2, 4.0).otherwise(1.0)
    )


def age_factor(as_of: Column) -> Column:
    """By months of 30 days since the account was opened; unknown or bad dates score 5."""
    months = F.datediff(as_of, strip(F.col("account_open_date")).try_cast("date")) / 30
    return (
        F.when(months.isNull(), 5.0).when(months < 3, 7.0).when(months < 12, 4.0)
        .when(months < 24, 2.0).otherwise(1.0)
    )


def pep_factor() -> Column:
    return (
        F.when(F.coalesce("is_pep", F.lit(False)), 9.0)
        .when(F.coalesce("is_pep_relative", F.lit(False)), 7.0).otherwise(0.0)
    )


def funds_factor() -> Column:
    source = F.lower(_text("source_of_funds"))
    score = F.lit(4.0)
    for points, words in reversed(list(vocab.FUND_SOURCE_WORDS.items())):
        any_word = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(source, w))
        score = F.when(any_word, F.lit(points)).otherwise(score)
    return score


def reasons(as_of: Column) -> dict[str, Column]:
    """The explanation of every factor, from the profile and the factor's score."""
    says = {name: F.lit(text) for name, text in vocab.RISK_REASONS.items()}

    def listed(table: Mapping[str, int], value: Column) -> Column:
        return _score(table, value).isNotNull()

    def one_decimal(value: Column) -> Column:
        return F.format_string("%.1f", F.round(value, 1))

    def filled(name: str, value: Column) -> Column:
        return F.replace(says[name], F.lit("%s"), value)

    def by_score(column: str, texts: Mapping[float, Column], other: Column) -> Column:
        out = other
        for score, text in texts.items():
            out = F.when(F.col(column) == score, text).otherwise(out)
        return out

    nation, home = _text("nationality"), _text("country_of_residence")
    nationality = F.when(
        listed(vocab.HIGH_RISK_COUNTRIES, nation), F.concat(says["country_high"], nation)
    ).when(listed(vocab.MEDIUM_RISK_COUNTRIES, nation), F.concat(says["country_medium"], nation))
    residence = F.when(
        listed(vocab.HIGH_RISK_COUNTRIES, home), F.concat(says["country_home"], home)
    )
    country = F.nullif(F.concat_ws("; ", nationality, residence), F.lit(""))

    def likeness(kind: str, table: Mapping[str, int], value: Column, score: str) -> Column:
        standard = (F.col(score) == 2.0) & ~listed(table, value)
        return (
            F.when(listed(table, value), F.concat(says[f"{kind}_listed"], value))
            .when(standard, says[f"{kind}_other"])
            .otherwise(F.concat(says[f"{kind}_like"], value))
        )

    job, trade = _text("occupation"), _text("business_type")
    business = likeness("business", vocab.HIGH_RISK_BUSINESS_TYPES, trade, "business_type_score")
    income = F.coalesce("declared_monthly_income", F.lit(0.0))
    volume = F.coalesce("monthly_transaction_volume", F.lit(0.0))
    ratio = one_decimal(volume / F.nullif(income, F.lit(0.0)))
    opened = strip(F.col("account_open_date"))
    months = F.datediff(as_of, opened.try_cast("date")) / 30
    whole = F.rint(months).cast("long").cast("string")
    funds, source = "source_of_funds_score", _text("source_of_funds")
    return {
        "country": F.coalesce(country, says["country_low"]),
        "occupation": likeness("occupation", vocab.HIGH_RISK_OCCUPATIONS, job, "occupation_score"),
        "business_type": F.when(
            F.col("customer_type") == vocab.INDIVIDUAL, says["business_none"]
        ).otherwise(business),
        "transaction_volume": F.when(income <= 0, says["volume_no_income"]).otherwise(
            by_score(
                "transaction_volume_score",
                {points: filled(f"volume_{points}", ratio) for points in (8, 6, 4)},
                says["volume_1"],
            )
        ),
        "account_age": (
            F.when(F.length(F.coalesce(opened, F.lit(""))) == 0, says["age_unknown"])
            .when(months.isNull(), says["age_bad"])
            .otherwise(
                by_score(
                    "account_age_score",
                    {points: filled(f"age_{points}", whole) for points in (7, 4, 2)},
                    filled("age_1", one_decimal(months / 12)),
                )
            )
        ),
        "pep_status": by_score(
            "pep_status_score", {9.0: says["pep_9"], 7.0: says["pep_7"]}, says["pep_0"]
        ),
        "source_of_funds": by_score(
            funds, {float(p): F.concat(says[f"funds_{p}"], source) for p in (6, 3, 1)},
            says["funds_4"],
        ),
    }


def category(score: Column, high: float = 60.0, medium: float = 30.0) -> Column:
    return (
        F.when(score >= 90, vocab.RISK_PROHIBITED).when(score >= high, vocab.RISK_HIGH)
        .when(score >= medium, vocab.RISK_MEDIUM).otherwise(vocab.RISK_LOW)
    )


def review_date(risk: Column, as_of: Column, months: Mapping[str, int], default: int) -> Column:
    """Months of 30 days from ``as_of``, by risk category."""
    wait = F.coalesce(F.try_element_at(lookup(months), risk), F.lit(default))
    return F.date_add(as_of, wait * 30)


def assess(
    profiles: DataFrame, as_of: Column, weights: Mapping[str, float] | None = None,
    high: float = 60.0, medium: float = 30.0, strict: bool = False,
) -> DataFrame:
    """Profiles plus factor scores, overall score, category, advice, actions, review date."""
    merged = {**vocab.RISK_WEIGHTS, **(weights or {})}
    share = {name: w / sum(merged.values()) for name, w in merged.items()}
    scores = dict(
        zip(
            FACTORS,
            (
                country_factor(), occupation_factor(strict), business_factor(), volume_factor(),
                age_factor(as_of), pep_factor(), funds_factor(),
            ),
        )
    )
    scored = profiles.withColumns({f"{name}_score": s for name, s in scores.items()})
    why = reasons(as_of)
    total = F.lit(0.0)
    for name in FACTORS:
        total += F.col(f"{name}_score") * F.lit(share[name])
    total = total * 10
    total += F.when(F.coalesce("has_adverse_media", F.lit(False)), 15.0).otherwise(0.0)
    total += F.when(F.coalesce("previous_str_filed", F.lit(False)), 20.0).otherwise(0.0)
    factors = F.array(
        *[
            F.struct(
                F.lit(vocab.RISK_FACTOR_NAMES[name]).alias("name"),
                F.col(f"{name}_score").alias("score"),
                F.lit(share[name]).alias("weight"),
                (F.col(f"{name}_score") * F.lit(share[name])).alias("weighted_score"),
                why[name].alias("reason"),
            )
            for name in FACTORS
        ]
    )
    risk = F.col("risk_category")
    elevated = risk.isin(vocab.RISK_HIGH, vocab.RISK_PROHIBITED)
    advice = [F.when(elevated, F.lit(t)) for t in vocab.ADVICE_ENHANCED]
    advice += [F.when(risk == vocab.RISK_MEDIUM, F.lit(t)) for t in vocab.ADVICE_STANDARD]
    advice += [
        F.when(F.col(f"{name}_score") >= 7, F.lit(vocab.ADVICE_BY_FACTOR[name]))
        for name in FACTORS if name in vocab.ADVICE_BY_FACTOR
    ]
    actions = [
        F.when(risk == level, F.lit(t)) for level, texts in vocab.ACTIONS.items() for t in texts
    ]
    return (
        scored.withColumn("overall_score", F.least(total, F.lit(100.0)))
        .withColumn("risk_category", category(F.col("overall_score"), high, medium))
        .withColumns(
            {
                "risk_factors": factors,
                "recommendations": F.array_compact(F.array(*advice)),
                "required_actions": F.array_compact(F.array(*actions)),
                "next_review_date": review_date(risk, as_of, vocab.RISK_REVIEW_MONTHS, 12),
            }
        )
    )


def summary(assessed: DataFrame) -> DataFrame:
    """One line per customer with the three heaviest factors."""
    top = top_structs(F.col("risk_factors"), "weighted_score", 3)
    text = F.concat_ws(
        ", ",
        F.transform(top, lambda f: F.concat(
            f["name"], F.lit("("), F.format_number(f["score"], 1), F.lit(")"))),
    )
    return assessed.select(
        "customer_id", "overall_score", "risk_category", text.alias("top_factors")
    )


# --- due diligence --------------------------------------------------------------------------------
def diligence_level() -> Column:
    flag = F.lit(False)
    for name in ("is_pep", "is_pep_relative", "has_adverse_media"):
        flag |= F.coalesce(name, F.lit(False))
    risk = F.col("risk_category")
    small = F.coalesce("monthly_transaction_volume", F.lit(0.0)) < 50_000
    return (
        F.when(risk.isin(vocab.RISK_HIGH, vocab.RISK_PROHIBITED) | flag, vocab.LEVEL_ENHANCED)
        .when((risk == vocab.RISK_LOW) & small, vocab.LEVEL_SIMPLE)
        .otherwise(vocab.LEVEL_STANDARD)
    )


def required_documents() -> Column:
    """Document types by level; company papers only for corporate customers."""
    level = F.col("dd_level")
    more = level.isin(vocab.LEVEL_STANDARD, vocab.LEVEL_ENHANCED)
    full = level == vocab.LEVEL_ENHANCED
    company = F.col("customer_type") == vocab.CORPORATE
    rules = (
        (F.lit(True), vocab.DOC_ID), (more, vocab.DOC_ADDRESS), (full, vocab.DOC_FUNDS),
        (full, vocab.DOC_INCOME), (full, vocab.DOC_STATEMENT),
        (more & company, vocab.DOC_COMPANY), (full & company, vocab.DOC_OWNER),
    )
    return F.array_compact(F.array(*[F.when(needed, F.lit(doc)) for needed, doc in rules]))


def due_diligence(
    assessed: DataFrame, as_of: Column, auto_approve_low: bool = False
) -> DataFrame:
    """Level, required documents, first status and review date of a due-diligence case."""
    risk, level = F.col("risk_category"), F.col("dd_level")
    status = F.when(risk == vocab.RISK_PROHIBITED, vocab.CDD_REJECTED)
    if auto_approve_low:
        status = status.when(risk == vocab.RISK_LOW, vocab.CDD_APPROVED)
    status = status.when(level == vocab.LEVEL_ENHANCED, vocab.CDD_DOCUMENTS).otherwise(
        vocab.CDD_IN_PROGRESS
    )
    return (
        assessed.withColumn("dd_level", diligence_level())
        .withColumn("required_documents", required_documents())
        .withColumn("cdd_status", status)
        .withColumn("cdd_review_date", review_date(risk, as_of, vocab.CDD_REVIEW_MONTHS, 24))
    )


def documents_received(diligence: DataFrame, submissions: DataFrame) -> DataFrame:
    """Apply ``customer_id, document_type, verified, submitted_at`` to the requirements.

    A case waiting for documents moves to review once every required one was given.
    The verified mark is the one of the newest submission.
    """
    needed = diligence.select(
        "customer_id", F.explode_outer("required_documents").alias("document_type")
    )
    given = submissions.groupBy("customer_id", "document_type").agg(
        F.max(F.struct("submitted_at", "verified"))["verified"].alias("verified")
    )
    folded = (
        needed.join(given, ["customer_id", "document_type"], "left")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("documents_required"),
            F.count("verified").alias("documents_provided"),
            F.count_if("verified").alias("documents_verified"),
        )
    )
    complete = F.col("documents_provided") == F.col("documents_required")
    waiting = F.col("cdd_status") == vocab.CDD_DOCUMENTS
    return (
        diligence.join(folded, "customer_id", "left")
        .withColumn("documents_complete", complete)
        .withColumn(
            "cdd_status",
            F.when(F.coalesce(complete, F.lit(False)) & waiting, vocab.CDD_REVIEW)
            .otherwise(F.col("cdd_status")),
        )
    )


def diligence_status(diligence: DataFrame, log: DataFrame) -> DataFrame:
    """Newest status of a log ``customer_id, new_status, changed_at, changed_by``."""
    latest = log.groupBy("customer_id").agg(
        F.max(F.struct("changed_at", "new_status", "changed_by")).alias("u")
    )
    final = F.col("cdd_status").isin(vocab.CDD_APPROVED, vocab.CDD_REJECTED)
    return (
        diligence.join(latest, "customer_id", "left")
        .withColumn("cdd_status", F.coalesce("u.new_status", "cdd_status"))
        .withColumn("completed_at", F.when(final, F.col("u.changed_at")))
        .withColumn("pending", ~final)
        .drop("u")
    )


def diligence_stats(current: DataFrame) -> DataFrame:
    """Cases in total, by status, level, category and pending state, in one pass."""
    final = F.col("cdd_status").isin(vocab.CDD_APPROVED, vocab.CDD_REJECTED)
    state = F.when(final, F.lit("done")).otherwise(F.lit("pending"))
    return _breakdown(
        current.withColumn("state", state),
        ("cdd_status", "dd_level", "risk_category", "state"), "customers",
    )
