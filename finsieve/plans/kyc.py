"""Queries over customers: risk, due diligence, name screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S
from finsieve.functions.identity import display_identity
from finsieve.operators import risk as R
from finsieve.operators import screening as N
from finsieve.plans import tables as T
from finsieve.plans.registry import query

_DAY = "2024-01-01"
_TYPES = (vocab.INDIVIDUAL, vocab.CORPORATE, "KOBI")
_NATIONS = ("Iran", "UAE", "France", "Pakistan", "TC")
_HOMES = ("Türkiye", "Syria", "Malta")
_JOBS = ("Avukat", "avukat yardimcisi", "Teacher", "", "Kuyumcu")
_TRADES = ("Real Estate", "Real Estate Agency", "Non-Profit", "Shop")
_FUNDS = ("maaş", "Kira geliri", "piyango", "")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a risk profile; unknown facts follow from its numbers."""
    n, nation = F.col("c_custkey"), F.col("c_nationkey")
    opened = F.date_sub(F.lit(_DAY).cast("date"), (n * 3 % 1200).cast("int"))
    return T.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("customer_id"), T._cycle(_TYPES, n % 3).alias("customer_type"),
        T._cycle(_NATIONS, nation % 5).alias("nationality"),
        T._cycle(_HOMES, n % 3).alias("country_of_residence"),
        T._cycle(_JOBS, n % 5).alias("occupation"),
        T._cycle(_TRADES, n % 4).alias("business_type"),
        F.when(n % 13 == 0, "unknown").when(n % 17 != 0, opened.cast("string"))
        .alias("account_open_date"),
        F.col("c_acctbal").alias("declared_monthly_income"),
        (F.abs("c_acctbal") * (n % 8)).alias("monthly_transaction_volume"),
        T._cycle(_FUNDS, nation % 4).alias("source_of_funds"),
        (n % 29 == 0).alias("is_pep"), (n % 23 == 0).alias("is_pep_relative"),
        (n % 19 == 0).alias("has_adverse_media"), (n % 31 == 0).alias("previous_str_filed"),
    )


def _pick(column: str, table: dict[str, int]) -> str:
    return "CASE " + column + " " + " ".join(
        f"WHEN '{k}' THEN {v}.0" for k, v in table.items()
    ) + " END"


def _first_listed(column: str, table: dict[str, int], both: bool) -> str:
    parts = []
    for name, points in table.items():
        low = name.lower().replace("i̇", "i̇")
        test = f"contains(lower({column}), '{low}')"
        if both:
            test += f" OR contains('{low}', lower({column}))"
        parts.append(f"WHEN {test} THEN CAST({points} AS DOUBLE) * 0.8")
    return "CASE " + " ".join(parts) + " END"


_TOTAL = sum(vocab.RISK_WEIGHTS.values())
_WEIGHTED = " + ".join(
    f"CAST({column} AS DOUBLE) * {weight / _TOTAL!r}e0"
    for column, weight in zip(
        ("f_country", "f_occupation", "f_business", "f_volume", "f_age", "f_pep", "f_funds"),
        vocab.RISK_WEIGHTS.values(),
    )
)

_PROFILES = f"""
profiles AS (
  SELECT c_name AS customer_id, c_custkey AS n,
         {T._sql_cycle(_TYPES, "c_custkey % 3")} AS customer_type,
         {T._sql_cycle(_NATIONS, "c_nationkey % 5")} AS nationality,
         {T._sql_cycle(_HOMES, "c_custkey % 3")} AS home,
         {T._sql_cycle(_JOBS, "c_custkey % 5")} AS occupation,
         {T._sql_cycle(_TRADES, "c_custkey % 4")} AS trade,
         CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 <> 0
              THEN CAST(c_custkey * 3 % 1200 AS INTEGER) END AS days,
         c_acctbal AS income, abs(c_acctbal) * (c_custkey % 8) AS volume,
         {T._sql_cycle(_FUNDS, "c_nationkey % 4")} AS funds,
         c_custkey % 29 = 0 AS pep, c_custkey % 23 = 0 AS relative,
         c_custkey % 19 = 0 AS media, c_custkey % 31 = 0 AS filed
  FROM customer
),
factors AS (
  SELECT *, greatest(
           coalesce({_pick("nationality", vocab.HIGH_RISK_COUNTRIES)},
                    {_pick("nationality", vocab.MEDIUM_RISK_COUNTRIES)}, 0),
           coalesce({_pick("home", vocab.HIGH_RISK_COUNTRIES)}, 0)) AS f_country,
         coalesce({_pick("occupation", vocab.HIGH_RISK_OCCUPATIONS)},
                  {_first_listed("occupation", vocab.HIGH_RISK_OCCUPATIONS, True)}, 2)
           AS f_occupation,
         CASE WHEN customer_type = 'BIREYSEL' THEN 0 ELSE
           coalesce({_pick("trade", vocab.HIGH_RISK_BUSINESS_TYPES)},
                    {_first_listed("trade", vocab.HIGH_RISK_BUSINESS_TYPES, False)}, 2) END
           AS f_business,
         CASE WHEN income <= 0 THEN 5 WHEN volume / income > 5 THEN 8
              WHEN volume / income > 3 THEN 6 WHEN volume / income > 2 THEN 4 ELSE 1 END
           AS f_volume,
         CASE WHEN days IS NULL THEN 5 WHEN days < 90 THEN 7 WHEN days < 360 THEN 4
              WHEN days < 720 THEN 2 ELSE 1 END AS f_age,
         CASE WHEN pep THEN 9 WHEN relative THEN 7 ELSE 0 END AS f_pep,
         CASE WHEN funds = 'piyango' THEN 6 WHEN funds LIKE 'Kira%' THEN 3
              WHEN funds = 'maaş' THEN 1 ELSE 4 END AS f_funds
  FROM profiles
),
assessed AS (
  SELECT *, CASE WHEN score >= 90 THEN 'YASAK' WHEN score >= 60 THEN 'YUKSEK'
                 WHEN score >= 30 THEN 'ORTA' ELSE 'DUSUK' END AS risk
  FROM (SELECT *, least(100, ({_WEIGHTED}) * 10 + CASE WHEN media THEN 15 ELSE 0 END + CASE WHEN filed THEN 20 ELSE 0 END)
                  AS score FROM factors)
),
diligence AS (
  SELECT *, CASE WHEN risk IN ('YUKSEK', 'YASAK') OR pep OR relative OR media
                   THEN 'GUCLENDIRILMIS'
                 WHEN risk = 'DUSUK' AND volume < 50000 THEN 'BASITLESTIRILMIS'
                 ELSE 'STANDART' END AS level
  FROM assessed
),
opened AS (
  SELECT *, CASE WHEN risk = 'YASAK' THEN 'REDDEDILDI' WHEN level = 'GUCLENDIRILMIS'
                 THEN 'BELGE_GEREKLI' ELSE 'DEVAM_EDIYOR' END AS status,
         1 + CASE level WHEN 'STANDART' THEN 1 WHEN 'GUCLENDIRILMIS' THEN 4 ELSE 0 END
           + CASE WHEN customer_type <> 'KURUMSAL' THEN 0 WHEN level = 'STANDART' THEN 1
                  WHEN level = 'GUCLENDIRILMIS' THEN 2 ELSE 0 END AS documents
  FROM diligence
)"""


def _as_of():
    return F.lit(_DAY).cast("date")


_WHY = vocab.RISK_REASONS


def _says(name: str, value: str | None = None) -> str:
    text = _WHY[name]
    if value is None:
        return f"'{text}'"
    return f"replace('{text}', '%s', {value})" if "%s" in text else f"'{text}' || {value}"


def _one_of(column: str, table: dict[str, int]) -> str:
    return f"{column} IN (" + ", ".join(f"'{k}'" for k in table) + ")"


_RATIO = "printf('%.1f', round(volume / income, 1))"
_MONTHS = "CAST(CAST(round_even(days / 30, 0) AS BIGINT) AS VARCHAR)"
_REASONS = f"""
               concat_ws(' | ',
                 CASE WHEN f_country = 0 THEN {_says("country_low")} ELSE concat_ws('; ',
                   CASE WHEN {_one_of("nationality", vocab.HIGH_RISK_COUNTRIES)}
                          THEN {_says("country_high", "nationality")}
                        WHEN {_one_of("nationality", vocab.MEDIUM_RISK_COUNTRIES)}
                          THEN {_says("country_medium", "nationality")} END,
                   CASE WHEN {_one_of("home", vocab.HIGH_RISK_COUNTRIES)}
                          THEN {_says("country_home", "home")} END) END,
                 CASE WHEN {_one_of("occupation", vocab.HIGH_RISK_OCCUPATIONS)}
                        THEN {_says("occupation_listed", "occupation")}
                      WHEN f_occupation = 2 THEN {_says("occupation_other")}
                      ELSE {_says("occupation_like", "occupation")} END,
                 CASE WHEN customer_type = 'BIREYSEL' THEN {_says("business_none")}
                      WHEN {_one_of("trade", vocab.HIGH_RISK_BUSINESS_TYPES)}
                        THEN {_says("business_listed", "trade")}
                      WHEN f_business = 2 THEN {_says("business_other")}
                      ELSE {_says("business_like", "trade")} END,
                 CASE WHEN income <= 0 THEN {_says("volume_no_income")}
                      WHEN f_volume = 8 THEN {_says("volume_8", _RATIO)}
                      WHEN f_volume = 6 THEN {_says("volume_6", _RATIO)}
                      WHEN f_volume = 4 THEN {_says("volume_4", _RATIO)}
                      ELSE {_says("volume_1")} END,
                 CASE WHEN n % 13 = 0 THEN {_says("age_bad")}
                      WHEN days IS NULL THEN {_says("age_unknown")}
                      WHEN f_age = 7 THEN {_says("age_7", _MONTHS)}
                      WHEN f_age = 4 THEN {_says("age_4", _MONTHS)}
                      WHEN f_age = 2 THEN {_says("age_2", _MONTHS)}
                      ELSE {_says("age_1", "printf('%.1f', round(days / 30 / 12, 1))")} END,
                 CASE WHEN pep THEN {_says("pep_9")} WHEN relative THEN {_says("pep_7")}
                      ELSE {_says("pep_0")} END,
                 CASE WHEN f_funds = 6 THEN {_says("funds_6", "funds")}
                      WHEN f_funds = 3 THEN {_says("funds_3", "funds")}
                      WHEN f_funds = 1 THEN {_says("funds_1", "funds")}
                      ELSE {_says("funds_4")} END) AS reasons"""


@query(
    "G1 G2 G3 G4 G5 G6 G7 G8 G9 G10 G11",
    T.with_ctes(
        _PROFILES,
        """
        SELECT customer_id, CAST(f_country AS DOUBLE) AS country,
               round(CAST(f_occupation AS DOUBLE), 2) AS occupation,
               round(CAST(f_business AS DOUBLE), 2) AS business,
               CAST(f_volume AS DOUBLE) AS volume, CAST(f_age AS DOUBLE) AS age,
               CAST(f_pep AS DOUBLE) AS pep, CAST(f_funds AS DOUBLE) AS funds,
               round(CAST(score AS DOUBLE), 4) AS overall_score, risk AS risk_category,
               CASE risk WHEN 'YASAK' THEN 3 WHEN 'YUKSEK' THEN 3 WHEN 'ORTA' THEN 2 ELSE 0 END
                 + (f_country >= 7)::INT + (f_volume >= 7)::INT + (f_pep >= 7)::INT AS advice,
               CASE risk WHEN 'YASAK' THEN 2 WHEN 'YUKSEK' THEN 3 WHEN 'ORTA' THEN 1 ELSE 0 END
                 AS actions,
               strftime(DATE '2024-01-01' + CAST(30 * CASE risk WHEN 'DUSUK' THEN 24
                 WHEN 'ORTA' THEN 12 WHEN 'YUKSEK' THEN 6 ELSE 0 END AS INTEGER), '%Y-%m-%d')
                 AS next_review,
        """
        + _REASONS
        + " FROM assessed",
    ),
)
def customer_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven factors, score, category, advice and review date of every customer."""
    rows = R.assess(profiles(spark, sf_dir), _as_of())
    short = {"business_type": "business", "transaction_volume": "volume",
             "account_age": "age", "pep_status": "pep", "source_of_funds": "funds"}
    return rows.select(
        "customer_id",
        *[F.round(f"{f}_score", 2).alias(short.get(f, f)) for f in R.FACTORS],
        F.round("overall_score", 4).alias("overall_score"), "risk_category",
        F.size("recommendations").alias("advice"), F.size("required_actions").alias("actions"),
        F.col("next_review_date").cast("string").alias("next_review"),
        F.concat_ws(" | ", F.transform("risk_factors", lambda f: f["reason"])).alias("reasons"),
    )


@query(
    "G12 C8",
    T.with_ctes(
        _PROFILES
        + """,
        parts AS (
          SELECT customer_id, unnest([
            struct_pack(i := 1, name := 'Ülke Riski', w := f_country * 0.20),
            struct_pack(i := 2, name := 'Meslek Riski', w := f_occupation * 0.15),
            struct_pack(i := 3, name := 'İş Türü Riski', w := f_business * 0.15),
            struct_pack(i := 4, name := 'İşlem Hacmi Riski', w := f_volume * 0.15),
            struct_pack(i := 5, name := 'Hesap Yaşı Riski', w := f_age * 0.10),
            struct_pack(i := 6, name := 'PEP Durumu', w := f_pep * 0.15),
            struct_pack(i := 7, name := 'Fon Kaynağı Riski', w := f_funds * 0.10)]) AS p
          FROM factors),
        ranked AS (SELECT customer_id, p.name AS name, p.i AS i, round(CAST(p.w AS DOUBLE), 9) AS w
                   FROM parts)""",
        """
        SELECT customer_id, string_agg(name, ', ' ORDER BY w DESC, i) AS top_factors
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY w DESC, i) AS rn
              FROM ranked) WHERE rn <= 3 GROUP BY customer_id
        """,
    ),
)
def heaviest_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three factors that weigh most, per customer."""
    from finsieve.operators.ordering import top_structs

    rows = R.assess(profiles(spark, sf_dir), _as_of())
    rounded = F.transform(
        "risk_factors",
        lambda f: F.struct(f["name"].alias("name"), F.round(f["weighted_score"], 9).alias("w")),
    )
    top = F.transform(top_structs(rounded, "w", 3), lambda f: f["name"])
    return rows.select("customer_id", F.concat_ws(", ", top).alias("top_factors"))


@query(
    "G11 G17 G18 G19",
    T.with_ctes(
        _PROFILES,
        """
        SELECT customer_id, level AS dd_level, CAST(documents AS BIGINT) AS documents,
               status AS cdd_status,
               strftime(DATE '2024-01-01' + CAST(30 * CASE risk WHEN 'DUSUK' THEN 36
                 WHEN 'ORTA' THEN 24 WHEN 'YUKSEK' THEN 12 ELSE 0 END AS INTEGER), '%Y-%m-%d')
                 AS cdd_review
        FROM opened
        """,
    ),
)
def due_diligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, number of documents, first status and review date."""
    rows = R.due_diligence(R.assess(profiles(spark, sf_dir), _as_of()), _as_of())
    return rows.select(
        "customer_id", "dd_level",
        F.size("required_documents").cast("long").alias("documents"), "cdd_status",
        F.col("cdd_review_date").cast("string").alias("cdd_review"),
    )


def submissions(diligence: DataFrame) -> DataFrame:
    """Documents handed in: all of them, or all but the first, by customer number."""
    n = F.substring("customer_id", 10, 12).cast("long")
    given = F.when(n % 2 == 0, F.col("required_documents")).otherwise(
        F.slice("required_documents", 2, 10)
    )
    return diligence.select("customer_id", n.alias("n"), F.explode_outer(given).alias("document_type")) \
        .select(
            "customer_id", "document_type", (F.col("n") % 3 == 0).alias("verified"),
            F.lit(_DAY).cast("timestamp").alias("submitted_at"),
        )


@query(
    "G20",
    T.with_ctes(
        _PROFILES
        + """,
        given AS (SELECT *, CASE WHEN n % 2 = 0 THEN documents ELSE documents - 1 END AS provided
                  FROM opened)""",
        """
        SELECT customer_id, CAST(provided AS BIGINT) AS documents_provided,
               CAST(CASE WHEN n % 3 = 0 THEN provided ELSE 0 END AS BIGINT) AS documents_verified,
               provided = documents AS documents_complete,
               CASE WHEN provided = documents AND status = 'BELGE_GEREKLI' THEN 'INCELEMEDE'
                    ELSE status END AS cdd_status
        FROM given
        """,
    ),
)
def documents_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted documents applied to the requirements."""
    opened = R.due_diligence(R.assess(profiles(spark, sf_dir), _as_of()), _as_of())
    rows = R.documents_received(opened, submissions(opened))
    return rows.select("customer_id", "documents_provided", "documents_verified",
                       "documents_complete", "cdd_status")


@query(
    "G21",
    T.with_ctes(
        _PROFILES
        + """,
        final AS (
          SELECT *, CASE WHEN n % 4 = 0 THEN 'ONAYLANDI' WHEN n % 4 = 1 THEN 'REDDEDILDI'
                         ELSE status END AS now_status FROM opened),
        s AS (SELECT *, CASE WHEN now_status IN ('ONAYLANDI', 'REDDEDILDI') THEN 'done'
                             ELSE 'pending' END AS state FROM final)""",
        """
        SELECT CASE WHEN GROUPING(now_status) = 0 THEN 'cdd_status'
                    WHEN GROUPING(level) = 0 THEN 'dd_level'
                    WHEN GROUPING(risk) = 0 THEN 'risk_category'
                    WHEN GROUPING(state) = 0 THEN 'state' ELSE 'total' END AS breakdown,
               coalesce(now_status, level, risk, state, 'all') AS value, count(*) AS customers
        FROM s GROUP BY GROUPING SETS ((), (now_status), (level), (risk), (state))
        """,
    ),
)
def diligence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due-diligence cases by status, level and category after a status log."""
    opened = R.due_diligence(R.assess(profiles(spark, sf_dir), _as_of()), _as_of())
    n = F.substring("customer_id", 10, 12).cast("long")
    turns = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    log = opened.select("customer_id", n.alias("n"), turns).where("n % 4 < 2").select(
        "customer_id",
        F.when(F.col("turn") == 0, vocab.CDD_REVIEW)
        .when(F.col("n") % 4 == 0, vocab.CDD_APPROVED).otherwise(vocab.CDD_REJECTED)
        .alias("new_status"),
        F.timestamp_micros(F.col("turn") * F.lit(S.DAY_US)).alias("changed_at"),
        F.lit("analyst").alias("changed_by"),
    )
    return R.diligence_stats(R.diligence_status(opened, log))


# --- screening --------------------------------------------------------------------------------
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as people: two words of the name, with the type as a third."""
    return T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("customer_id"),
        F.concat_ws(" ", F.initcap("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")))
        .alias("full_name"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as entries; some carry their type or miss the last letters."""
    names = T.table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    second = F.element_at(F.split("p_name", " "), 2)
    first = F.element_at(F.split("p_name", " "), 1)
    economy = F.col("p_type") == "ECONOMY"
    return names.select(
        F.when(economy, F.concat_ws("-", "p_name", "p_type"))
        .otherwise(F.substring("p_name", 1, 8)).alias("name"),
        F.array(F.concat_ws(" ", second, first)).alias("aliases"),
    ).distinct().select(
        "name", "aliases", F.lit("UN").alias("list"), F.lit("test").alias("reason"),
        F.when(F.contains("name", F.lit("red")), "YURT_ICI_YUKSEK")
        .otherwise("YAKIN_AILE").alias("level"),
        F.lit("post").alias("position"), F.lit("TR").alias("country"),
        F.lit(True).alias("active"),
    )


_SIMILAR = """CASE WHEN a = b THEN 100.0 WHEN contains(a, b) OR contains(b, a) THEN 90.0
               ELSE 100.0 * len(list_intersect(list_distinct(string_split(a, ' ')),
                                               list_distinct(string_split(b, ' '))))
                    / greatest(len(list_distinct(string_split(a, ' '))),
                               len(list_distinct(string_split(b, ' ')))) END"""

_WATCH = """
people AS (
  SELECT CAST(p_partkey AS VARCHAR) AS customer_id,
         lower(p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END) AS a
  FROM part),
watch AS (
  SELECT DISTINCT CASE WHEN p_type = 'ECONOMY' THEN p_name || '-' || p_type
                       ELSE substr(p_name, 1, 8) END AS name,
         string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS alias
  FROM part),
entries AS (
  SELECT name, 0 AS pos, lower(replace(name, '-', '')) AS b FROM watch
  UNION ALL SELECT name, 1, lower(alias) FROM watch)"""


@query(
    "B20 B21 G13",
    T.with_ctes(
        _WATCH
        + f""",
        scored AS (
          SELECT a, b, {_SIMILAR} AS score
          FROM (SELECT DISTINCT a FROM people), (SELECT DISTINCT b FROM entries WHERE pos = 0))""",
        """
        SELECT p.customer_id, w.name AS matched_name, round(s.score, 4) AS match_score,
               CASE WHEN s.score >= 95 THEN 'TAM_ESLESME' WHEN s.score >= 85 THEN 'KISMI_ESLESME'
                    ELSE 'BULANIK_ESLESME' END AS match_type, count(*) AS n
        FROM people p JOIN scored s ON s.a = p.a AND s.score >= 70
        JOIN (SELECT name, lower(replace(name, '-', '')) AS b FROM watch) w ON w.b = s.b
        GROUP BY ALL
        """,
    ),
)
def pep_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone against the list of exposed persons."""
    found = N.screen_pep(people(spark, sf_dir), watchlist(spark, sf_dir))
    return found.groupBy(
        "customer_id", "matched_name", F.round("match_score", 4).alias("match_score"),
        "match_type",
    ).agg(F.count("*").alias("n"))


_SANCTIONS = (
    _WATCH
    + f""",
scored AS (
  SELECT a, b, {_SIMILAR} AS score
  FROM (SELECT DISTINCT a FROM people), (SELECT DISTINCT b FROM entries)),
matched AS (
  SELECT p.customer_id, e.name, arg_min(struct_pack(pos, score := s.score), (e.pos, s.score)) AS m
  FROM people p JOIN scored s ON s.a = p.a AND s.score >= 70
  JOIN entries e ON e.b = s.b GROUP BY p.customer_id, e.name)"""
)


@query(
    "G14",
    T.with_ctes(
        _SANCTIONS,
        """
        SELECT customer_id, name AS matched_name, round(m.score, 4) AS match_score,
               CASE WHEN m.score >= 95 THEN 'TAM_ESLESME' WHEN m.pos = 1 THEN 'TAKMA_AD'
                    WHEN m.score >= 85 THEN 'KISMI_ESLESME' ELSE 'BULANIK_ESLESME' END
                 AS match_type
        FROM matched
        """,
    ),
)
def sanction_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone against names and aliases of sanctioned entities."""
    found = N.screen_sanctions(people(spark, sf_dir), watchlist(spark, sf_dir))
    return found.select("customer_id", "matched_name",
                        F.round("match_score", 4).alias("match_score"), "match_type")


@query(
    "G13 G14 G15",
    T.with_ctes(
        _SANCTIONS
        + """,
        pep AS (
          SELECT p.customer_id, count(*) AS n, max(s.score) AS best, bool_or(contains(w.name, 'red'))
                   AS high
          FROM people p JOIN scored s ON s.a = p.a AND s.score >= 70
          JOIN (SELECT name, lower(replace(name, '-', '')) AS b FROM watch) w ON w.b = s.b
          GROUP BY p.customer_id),
        san AS (SELECT customer_id, count(*) AS n FROM matched GROUP BY customer_id)""",
        f"""
        SELECT p.customer_id, coalesce(e.n, 0) + coalesce(s.n, 0) AS matches,
               round(greatest(CASE WHEN s.n > 0 THEN 100.0 ELSE 0 END,
                 coalesce(least(100.0, e.best * CASE WHEN e.high THEN 1.5 ELSE 1 END), 0)), 4)
                 AS risk_score,
               CASE WHEN s.n > 0 THEN '{vocab.SCREEN_FULL_SANCTION}'
                    WHEN e.n > 0 THEN '{vocab.SCREEN_PEP}' ELSE '{vocab.SCREEN_CLEAN}' END
                 AS recommendation
        FROM people p LEFT JOIN pep e ON e.customer_id = p.customer_id
        LEFT JOIN san s ON s.customer_id = p.customer_id
        """,
    ),
)
def full_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined screening result of everyone."""
    who, listed = people(spark, sf_dir), watchlist(spark, sf_dir)
    pep = N.pep_results(who, N.screen_pep(who, listed))
    san = N.sanction_results(who, N.screen_sanctions(who, listed))
    return N.screen_full(pep, san).withColumn("risk_score", F.round("risk_score", 4))


_MEDIA = ("erblest", "ation", "fraud")


@query(
    "G16",
    f"""
    SELECT doc_id, array_to_string(list_filter(['{"', '".join(_MEDIA)}'],
             lambda w: contains(lower(text), w)), ',') AS keywords
    FROM documents
    WHERE len(list_filter(['{"', '".join(_MEDIA)}'], lambda w: contains(lower(text), w))) > 0
    """,
)
def adverse_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with adverse-media words."""
    found = N.adverse_media(T.table(spark, sf_dir, "documents"), _MEDIA)
    return found.select("doc_id", F.concat_ws(",", "keywords").alias("keywords"))


@query(
    "B15 B16",
    f"""
    WITH d AS (
      SELECT c_custkey, sha256('{vocab.IDENTITY_VERSION}:' || CAST(c_custkey AS VARCHAR)) AS h
      FROM customer),
    p AS (SELECT c_custkey,
                 CAST(('0x' || substr(h, 1, 14))::UBIGINT AS UBIGINT) AS by8,
                 ('0x' || substr(h, 1, 16))::UBIGINT AS full_pick,
                 ('0x' || substr(h, 1, 12))::UBIGINT AS by16 FROM d),
    b AS (SELECT *, '9' || lpad(CAST(full_pick % 11 + 1 AS VARCHAR), 4, '0') || '0'
                    || lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS bban FROM p)
    SELECT c_custkey,
           'TR' || lpad(CAST(98 - CAST(bban || '292700' AS HUGEINT) % 97 AS VARCHAR), 2, '0')
             || bban AS iban,
           ['{"', '".join(vocab.FIRST_NAMES)}'][CAST(by8 % 80 AS INTEGER) + 1] AS first_name,
           ['{"', '".join(vocab.LAST_NAMES)}'][CAST(by16 % 60 AS INTEGER) + 1] AS last_name,
           true AS valid_iban
    FROM b
    """,
)
def display_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display IBAN and name of every customer number."""
    rows = T.table(spark, sf_dir, "customer").select(
        "c_custkey", display_identity(F.col("c_custkey").cast("string")).alias("d")
    )
    words = F.split("d.name", " ")
    return rows.select(
        "c_custkey", "d.iban", words[0].alias("first_name"),
        F.element_at(words, -1).alias("last_name"), S.is_tr_iban(F.col("d.iban"))
        .alias("valid_iban"),
    )
