"""Queries over the money-flow graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators import graph as G
from finsieve.operators import rings as R
from finsieve.plans import tables as T
from finsieve.plans.registry import query

_AS_OF = "2024-01-20 00:00:00"
_EDGES = T.MONEY_EDGES.format(at_least=0)


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.money_edges(spark, sf_dir, 0.0)


def _as_of(text: str = _AS_OF):
    return F.lit(text).cast("timestamp")


def _joined(column: str) -> F.Column:
    return F.concat_ws(",", column)


def _walks(max_hops: int, root: str = "", edges: str = "edges", name: str = "walks", ok: str = "") -> str:
    """CTE ``walks``: open walks over distinct transactions; ``ok`` also holds for each step."""
    return f"""
    {name} AS (
      SELECT src AS root, dst AS last, [id] AS ids, [src, dst] AS path,
             CAST(amount AS DECIMAL(38,4)) AS total, 1 AS hops
      FROM {edges} {f"WHERE src = '{root}'" if root else ""}
      UNION ALL
      SELECT w.root, e.dst, list_append(w.ids, e.id), list_append(w.path, e.dst),
             CAST(w.total + CAST(e.amount AS DECIMAL(38,4)) AS DECIMAL(38,4)), w.hops + 1
      FROM {name} w JOIN {edges} e ON e.src = w.last AND NOT list_contains(w.ids, e.id)
      WHERE w.hops < {max_hops} {ok}
    )"""


def _largest_walks(edges: str, min_hops: int, max_hops: int, limit: int, least: str, heavy: float = 0.92) -> str:
    """CTEs of walks that may become one of the ``limit`` largest rings of up to ``max_hops``.

    The rings of the heaviest transfers give a total that the answers reach at least; a
    walk goes on while the most that its end can still carry (``more``) may bring it there.
    """
    carried = ["m0 AS (SELECT DISTINCT src AS node, 0.0::DOUBLE AS most FROM core)"]
    for i in range(1, max_hops):
        carried.append(
            f"m{i} AS (SELECT c.src AS node, max(c.amount + m.most) AS most FROM core c"
            f" JOIN m{i - 1} m ON m.node = c.dst GROUP BY c.src)"
        )
    every = " UNION ALL ".join(f"SELECT node, {i} AS j, most FROM m{i}" for i in range(max_hops))
    return f"""
    core AS (SELECT * FROM {edges} WHERE src IN (SELECT dst FROM {edges}) AND dst IN (SELECT src FROM {edges})),
    heavy AS (SELECT * FROM core WHERE amount >= (SELECT quantile_disc(amount, {heavy}) FROM core)),
    {_walks(max_hops, edges="heavy", name="heavy_walks")},
    least AS (SELECT coalesce((
        SELECT total FROM heavy_walks WHERE last = root AND hops BETWEEN {min_hops} AND {max_hops}
          AND ids[1] = list_min(ids) ORDER BY total DESC LIMIT 1 OFFSET {limit - 1}), {least}) AS total),
    {", ".join(carried)},
    more AS (SELECT node, max(most) OVER (PARTITION BY node ORDER BY j) AS most, j FROM ({every})),
    {_walks(max_hops, edges="core", ok=f"""AND CAST(w.total AS DOUBLE) + e.amount + (
        SELECT most FROM more WHERE node = e.dst AND j = {max_hops} - 1 - w.hops) >= (SELECT total FROM least) - 0.001""")}"""


def _ring_columns(rings: DataFrame) -> DataFrame:
    return rings.select(
        _joined("path").alias("path"), _joined("transaction_ids").alias("transaction_ids"),
        F.round(F.col("total_amount").cast("double"), 2).alias("total_amount"),
        F.col("hops").cast("long").alias("hops"),
    )


_RING_SELECT = """array_to_string(path, ',') AS path,
               array_to_string(ids, ',') AS transaction_ids,
               round(CAST(total AS DOUBLE), 2) AS total_amount, CAST(hops AS BIGINT) AS hops"""


def _recursive(body: str) -> str:
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "E1",
    _recursive(
        T.with_ctes(
            _EDGES
            + f""",
            recent AS (SELECT * FROM edges WHERE ts > TIMESTAMP '{_AS_OF}' - INTERVAL 168 HOUR
                                             AND ts <= TIMESTAMP '{_AS_OF}'),"""
            + _walks(5, "U17", "recent"),
            f"""SELECT {_RING_SELECT} FROM walks WHERE last = root AND hops BETWEEN 3 AND 5
                ORDER BY total DESC, ids LIMIT 100""",
        )
    ),
)
def rings_through_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of the last week through one account."""
    return _ring_columns(G.rings_through(_money(spark, sf_dir), "U17", _as_of()))


@query(
    "E2 E4 C8",
    _recursive(
        T.with_ctes(
            _EDGES + "," + _largest_walks("edges", 3, 5, 50, "1000"),
            f"""SELECT {_RING_SELECT},
                       CASE WHEN total > 100000 THEN 'critical' ELSE 'high' END AS severity
                FROM walks WHERE last = root AND hops BETWEEN 3 AND 5 AND total >= 1000
                  AND ids[1] = list_min(ids)
                ORDER BY walks.total DESC, list_sort(ids), ids LIMIT 50""",
        )
    ),
)
def largest_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rings of the whole graph, at any time, each once."""
    rings = _ring_columns(R.all_rings(_money(spark, sf_dir)))
    return rings.withColumn("severity", G.ring_severity(F.col("total_amount")))


@query(
    "E3",
    _recursive(
        T.with_ctes(
            _EDGES + "," + _largest_walks("edges", 3, 5, 67, "1000"),
            f"""SELECT {_RING_SELECT} FROM walks
                WHERE last = root AND hops BETWEEN 3 AND 5 AND total >= 1000
                ORDER BY walks.total DESC, list_sort(ids), ids LIMIT 200""",
        )
    ),
)
def rings_every_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rings at any time, once per starting account."""
    return _ring_columns(R.all_rings(_money(spark, sf_dir), limit=200, dedupe=False))


@query(
    "E10",
    _recursive(
        T.with_ctes(
            _EDGES
            + f""",
            recent AS (SELECT * FROM edges WHERE ts > TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY
                                             AND ts <= TIMESTAMP '{_AS_OF}'),"""
            # With a hundred rings of six transfers no shorter one is among the longest;
            # with fewer all walks go on.
            + _largest_walks("recent", 6, 6, 100, "0", heavy=0.7),
            f"""SELECT {_RING_SELECT} FROM walks
                WHERE last = root AND hops BETWEEN 3 AND 6 AND ids[1] = list_min(ids)
                ORDER BY hops DESC, walks.total DESC, list_sort(ids), ids LIMIT 100""",
        )
    ),
)
def longest_recent_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of up to six hops in the last week, longest first."""
    return _ring_columns(R.longest_rings(_money(spark, sf_dir), _as_of()))


@query(
    "E11",
    _recursive(
        T.with_ctes(
            T.MONEY_EDGES.format(at_least=200) + "," + _walks(4),
            """SELECT root AS first_account, last AS last_account,
                      array_to_string(ids, ',') AS transaction_ids, CAST(hops AS BIGINT) AS edges,
                      round(CAST(total AS DOUBLE), 2) AS total_amount
               FROM walks WHERE hops >= 2""",
        )
    ),
)
def value_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open chains of two to four large transfers."""
    chains = G.value_chains(T.money_edges(spark, sf_dir, 0.0), above=200.0)
    return chains.select(
        "first_account", "last_account", _joined("transaction_ids").alias("transaction_ids"),
        F.col("edges").cast("long").alias("edges"),
        F.round(F.col("total_amount").cast("double"), 2).alias("total_amount"),
    )


@query(
    "E5",
    T.with_ctes(
        _EDGES
        + """,
        near AS (SELECT 'U17' AS node UNION SELECT dst FROM edges WHERE src = 'U17'
                 UNION SELECT src FROM edges WHERE dst = 'U17')""",
        """
        SELECT src, dst, id AS transaction_id, amount, (src = 'U17' OR dst = 'U17') AS is_center
        FROM edges WHERE src IN (SELECT node FROM near) OR dst IN (SELECT node FROM near)
        ORDER BY ts DESC, id DESC LIMIT 200
        """,
    ),
)
def account_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within two undirected steps of an account."""
    near = G.neighbourhood(_money(spark, sf_dir), "U17", depth=2)
    return near.select("src", "dst", "transaction_id", "amount", "is_center")


@query(
    "E6",
    T.with_ctes(
        T.MONEY_EDGES.format(at_least=0),
        """
        (SELECT src, dst, id AS transaction_id, amount FROM edges WHERE src = 'U17'
         ORDER BY ts DESC, id DESC LIMIT 40)
        UNION
        (SELECT src, dst, id, amount FROM edges WHERE dst = 'U17'
         ORDER BY ts DESC, id DESC LIMIT 40)
        """,
    ),
)
def account_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest sent and received transfers of an account."""
    rows = G.account_transactions(T.money_edges(spark, sf_dir, 0.0), "U17", limit=40)
    return rows.select("src", "dst", "transaction_id", "amount")


@query(
    "A9 E7",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT (SELECT count(*) FROM (SELECT sender_iban FROM received
                UNION SELECT receiver_iban FROM received)) AS user_count,
               count(*) AS transaction_count, round(sum(amount), 2) AS total_volume
        FROM received
        """,
    ),
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, transfers and volume of the graph."""
    rows = T.received(spark, sf_dir)
    stats = G.graph_stats(G.graph_edges(rows), G.graph_nodes(rows))
    return stats.withColumn("total_volume", F.round("total_volume", 2))


@query(
    "A9",
    T.with_ctes(
        T.RECEIVED
        + """,
        ends AS (
          SELECT sender_iban AS iban, sender_name AS name, sender_city AS city, "timestamp" AS ts,
                 transaction_id AS id, 0 AS e FROM received
          UNION ALL
          SELECT receiver_iban, receiver_name, receiver_city, "timestamp", transaction_id, 1
          FROM received)""",
        """
        SELECT iban, arg_max(name, (ts, id, e, name)) AS name,
               arg_max(city, (ts, id, e, city)) AS city
        FROM ends GROUP BY iban
        """,
    ),
)
def graph_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of the graph with their newest name and city."""
    return G.graph_nodes(T.received(spark, sf_dir))


_NETWORK = T.with_ctes(
    T.MONEY_EDGES.format(at_least=0)
    + f""",
    links AS (
      SELECT e.src, e.dst, e.id, e.ts, e.amount, r.fraud_type <> 'none' AS is_fraud
      FROM edges e JOIN rec x ON x.transaction_id = e.id JOIN received r ON r.seq = x.seq
      WHERE e.ts > TIMESTAMP '{_AS_OF}' - INTERVAL 24 HOUR AND e.ts <= TIMESTAMP '{_AS_OF}'
      ORDER BY e.ts DESC, e.id DESC LIMIT 100),
    ends AS (
      SELECT src AS iban, ts, 0 AS role, 1 AS sent, amount AS money, is_fraud FROM links
      UNION ALL SELECT dst, ts, 1, 0, 0, is_fraud FROM links),
    nodes AS (
      SELECT iban, CAST(sum(sent) AS BIGINT) AS tx_count, round(sum(money), 2) AS amount_total,
             bool_or(is_fraud) AS is_fraud, arg_min(role, (-epoch_us(ts), role)) AS role
      FROM ends GROUP BY iban)""",
    "{body}",
)


@query(
    "E8 B23 B29",
    _NETWORK.format(
        body="""SELECT iban, substr(iban, 1, 12) || '...' AS label, tx_count, amount_total,
                is_fraud, CAST(CASE WHEN is_fraud THEN 1 WHEN role = 0 THEN 2 ELSE 0 END AS BIGINT)
                  AS node_group FROM nodes"""
    ),
)
def recent_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in the newest transfers of the last day."""
    nodes, _ = G.recent_network(T.money_edges(spark, sf_dir, 0.0), _as_of())
    return nodes.select(
        "iban", "label", "tx_count", F.round("amount_total", 2).alias("amount_total"),
        "is_fraud", F.col("group").cast("long").alias("node_group"),
    )


@query(
    "E9",
    _NETWORK.format(
        body="""SELECT id AS transaction_id, src, dst, is_fraud FROM links
                WHERE src IN (SELECT iban FROM nodes WHERE is_fraud)
                   OR dst IN (SELECT iban FROM nodes WHERE is_fraud)"""
    ),
)
def fraud_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links touching an account that is marked as fraud."""
    nodes, links = G.recent_network(T.money_edges(spark, sf_dir, 0.0), _as_of())
    return G.fraud_subgraph(nodes, links)[1].select("transaction_id", "src", "dst", "is_fraud")


@query(
    "E12",
    T.with_ctes(
        T.MONEY_EDGES.format(at_least=0)
        + """,
        ends AS (
          SELECT src AS account, dst AS other, id, amount AS sent, 0 AS got FROM edges
          UNION ALL SELECT dst, src, id, 0, amount FROM edges)""",
        """
        SELECT account, count(DISTINCT id) AS transactions,
               count(DISTINCT other) AS counterparties, round(sum(sent), 2) AS amount_sent,
               round(sum(got), 2) AS amount_received
        FROM ends GROUP BY account
        """,
    ),
)
def account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers, counterparties and volumes per account."""
    rows = G.account_summary(T.money_edges(spark, sf_dir, 0.0))
    return rows.select(
        "account", "transactions", "counterparties",
        F.round("amount_sent", 2).alias("amount_sent"),
        F.round("amount_received", 2).alias("amount_received"),
    )


_PAIRS = (
    T.MONEY_EDGES.format(at_least=0)
    + """,
pairs AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
nodes AS (SELECT node, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree
          FROM (SELECT src AS node, true AS o FROM pairs UNION ALL SELECT dst, false FROM pairs)
          GROUP BY node)"""
)
_STEPS = 10


def _rank_ctes() -> str:
    parts = ["r0 AS (SELECT node, out_degree, 1.0::DOUBLE / count(*) OVER () AS r FROM nodes)"]
    for i in range(1, _STEPS + 1):
        parts.append(
            f"""r{i} AS (
              SELECT n.node, n.out_degree, 0.15::DOUBLE / count(*) OVER () + 0.85::DOUBLE * (
                coalesce((SELECT sum(p.r / p.out_degree) FROM r{i - 1} p JOIN pairs e
                          ON e.src = p.node WHERE e.dst = n.node), 0)
                + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE out_degree = 0)
                  / count(*) OVER ()) AS r
              FROM nodes n)"""
        )
    return ",\n".join(parts)


@query(
    "D16",
    T.with_ctes(
        _PAIRS
        + """,
        und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pairs),
        sym AS (SELECT a AS u, b AS v FROM und UNION ALL SELECT b, a FROM und),
        tri AS (SELECT x.u AS node, count(*) AS t FROM sym x JOIN sym y ON y.u = x.v
                JOIN sym z ON z.u = y.v AND z.v = x.u GROUP BY x.u),
        nb AS (SELECT u AS node, count(*) AS n FROM sym GROUP BY u),
        """
        + _rank_ctes()
        + """,
        reach AS (SELECT DISTINCT u AS node, u AS other FROM sym
                  UNION SELECT r.node, s.v FROM reach r JOIN sym s ON s.u = r.other),
        grouped AS (SELECT node, min(other) AS community FROM reach GROUP BY node)""",
        f"""
        SELECT n.node, g.community, CAST(n.out_degree AS BIGINT) AS out_degree,
               CAST(n.in_degree AS BIGINT) AS in_degree, round(r.r, 9) AS pagerank,
               round(CASE WHEN nb.n > 1 THEN coalesce(tri.t, 0) / (nb.n * (nb.n - 1.0)) ELSE 0 END,
                     9) AS clustering_coefficient,
               round((n.out_degree + n.in_degree) / (2.0 * (count(*) OVER () - 1)), 9) AS hub_score
        FROM nodes n JOIN r{_STEPS} r ON r.node = n.node JOIN nb ON nb.node = n.node
        JOIN grouped g ON g.node = n.node LEFT JOIN tri ON tri.node = n.node
        """,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, PageRank, clustering, hub score and community of every account."""
    from finsieve.operators import network as N

    rows = N.network_features(T.money_edges(spark, sf_dir, 0.0), iterations=_STEPS)
    return rows.select(
        "node", "community", "out_degree", "in_degree",
        *[F.round(c, 9).alias(c) for c in ("pagerank", "clustering_coefficient", "hub_score")],
    )


@query(
    "D16",
    _recursive(
        T.with_ctes(
            T.MONEY_EDGES.format(at_least=0)
            + """,
            sym AS (SELECT src AS u, dst AS v FROM edges WHERE src <> dst
                    UNION SELECT dst, src FROM edges WHERE src <> dst),
            reach AS (SELECT DISTINCT u AS node, u AS other FROM sym
                      UNION SELECT r.node, s.v FROM reach r JOIN sym s ON s.u = r.other)""",
            "SELECT node, min(other) AS community FROM reach GROUP BY node",
        )
    ),
)
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of accounts over all transfers."""
    from finsieve.operators import network as N

    return N.communities(N.connections(_money(spark, sf_dir)))
