"""Money-flow graph: ingest, rings through an account, neighbourhoods, summaries.

Edges are rows ``src, dst, transaction_id, timestamp, amount`` (plus optional
``fraud_type``); parallel edges and self loops are allowed. A ring is a closed walk
whose transactions are all different; accounts may repeat. Rings of the whole graph
are in :mod:`finsieve.operators.rings`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.session import cut_lineage

MONEY = "decimal(38,4)"


# --- ingest --------------------------------------------------------------------------------
def graph_edges(received: DataFrame) -> DataFrame:
    """One edge per transaction, with the defaults of the graph store."""
    def or_else(name: str, default: str) -> Column:
        given = [F.col(name)] if name in received.columns else []
        return F.coalesce(*given, F.lit(default)).alias(name)

    return received.select(
        F.col("sender_iban").alias("src"),
        F.col("receiver_iban").alias("dst"),
        or_else("transaction_id", ""),
        F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
        "timestamp",
        or_else("description", ""),
        or_else("fraud_type", "none"),
        (F.col("ring_id") if "ring_id" in received.columns else F.lit(None).cast("string"))
        .alias("ring_id"),
    )


def graph_nodes(received: DataFrame, batch: bool = False) -> DataFrame:
    """Accounts of both ends. Single upserts keep the newest known name and city;
    a batch keeps what the first sighting said, even when that was null."""
    ends = received.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(f"{side}_iban").alias("iban"),
                        F.col(f"{side}_name").alias("name"),
                        F.col(f"{side}_city").alias("city"),
                        F.struct(
                            F.unix_micros("timestamp").alias("t"),
                            F.col("transaction_id").alias("id"),
                            F.lit(end).alias("end"),
                        ).alias("at"),
                    )
                    for end, side in enumerate(("sender", "receiver"))
                ]
            )
        )
    )
    if batch:
        first = F.min(F.struct("at", "name", "city")).alias("f")
        return ends.groupBy("iban").agg(first).select("iban", "f.name", "f.city")

    def newest(name: str) -> Column:
        known = F.when(F.col(name).isNotNull(), F.struct("at", name))
        return F.max(known)[name].alias(name)

    return ends.groupBy("iban").agg(newest("name"), newest("city"))


# --- rings --------------------------------------------------------------------------------
def _core(edges: DataFrame) -> DataFrame:
    return edges.select(
        "src", "dst", F.col("transaction_id").alias("id"),
        F.unix_micros("timestamp").alias("t"), F.col("amount").cast(MONEY).alias("amount"),
    )


def _step(prefix: str = "") -> Column:
    names = ("src", "id", "t", "amount")
    return F.struct(*[F.col(prefix + n).alias(n) for n in names])


def _ids(steps: Column) -> Column:
    return F.transform(steps, lambda s: s["id"])


def _next_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col(c).alias(f"n_{c}") for c in edges.columns])


def _extend(paths: DataFrame, nexts: DataFrame) -> DataFrame:
    """One more transfer, which the walk has not used yet."""
    fresh = ~F.array_contains(_ids(F.col("steps")), F.col("n_id"))
    return paths.join(nexts, F.col("last") == F.col("n_src")).where(fresh).select(
        "root", F.col("n_dst").alias("last"),
        F.concat("steps", F.array(_step("n_"))).alias("steps"),
        F.least("t_min", "n_t").alias("t_min"), F.greatest("t_max", "n_t").alias("t_max"),
    )


def _close(paths: DataFrame, nexts: DataFrame) -> DataFrame:
    """The transfer back to the start; both ends are known, so nothing fans out."""
    back = (F.col("last") == F.col("n_src")) & (F.col("root") == F.col("n_dst"))
    fresh = ~F.array_contains(_ids(F.col("steps")), F.col("n_id"))
    return paths.join(nexts, back).where(fresh).select(
        F.concat("steps", F.array(_step("n_"))).alias("steps"),
        F.least("t_min", "n_t").alias("t_min"), F.greatest("t_max", "n_t").alias("t_max"),
    )


def _rotated(steps: Column, at: Column) -> Column:
    """The closed walk started at position ``at`` (1-based)."""
    n = F.size(steps)
    return F.concat(F.slice(steps, at, n), F.slice(steps, F.lit(1), at - 1))


def _describe(rings: DataFrame) -> DataFrame:
    """Ring columns from ``steps``: path (start repeated at the end), ids, total, times."""
    accounts = F.transform("steps", lambda s: s["src"])
    total = F.aggregate("steps", F.lit(0).cast(MONEY), lambda a, s: (a + s["amount"]).cast(MONEY))
    path = F.concat(accounts, F.slice(accounts, 1, 1))
    return rings.select(
        S.stable_id("RING", F.concat_ws(">", path)).alias("ring_id"),
        path.alias("path"),
        _ids(F.col("steps")).alias("transaction_ids"),
        total.alias("total_amount"),
        F.size("steps").alias("hops"),
        F.col("t_min").alias("first_us"),
        F.col("t_max").alias("last_us"),
        F.array_max(F.transform("steps", lambda s: F.struct(s["t"], s["id"])))["id"]
        .alias("last_id"),
        "steps",
    )


def rings_through(
    edges: DataFrame,
    account: str,
    as_of: Column,
    min_hops: int = 3,
    max_hops: int = 5,
    window_hours: float = 168,
    limit: int = 100,
) -> DataFrame:
    """Rings that start and end at one account, largest first.

    Edges must be newer than ``as_of`` minus the window. A step only goes to accounts
    from which the start can still be reached with the hops left.
    """
    now = F.unix_micros(as_of)
    recent = cut_lineage(
        _core(edges).where(
            (F.col("t") > now - int(window_hours * S.HOUR_US)) & (F.col("t") <= now)
        )
    )
    within = [recent.sparkSession.createDataFrame([(account,)], "node string")]
    for _ in range(max_hops - 2):
        reach = within[-1]
        before = recent.join(
            reach.select(F.col("node").alias("dst")), "dst", "left_semi"
        ).select(F.col("src").alias("node"))
        within.append(cut_lineage(reach.unionByName(before).distinct()))

    def towards(hops_left: int) -> DataFrame:
        goal = within[min(hops_left, len(within) - 1)].select(F.col("node").alias("dst"))
        return recent.join(goal, "dst", "left_semi")

    first = recent.where(F.col("src") == account)
    goal = recent.join(
        within[-1].select(F.col("node").alias("src")), "src", "left_semi"
    ).where(F.col("dst") == account)
    paths = first.select(
        F.col("src").alias("root"), F.col("dst").alias("last"),
        F.array(_step()).alias("steps"), F.col("t").alias("t_min"), F.col("t").alias("t_max"),
    )
    found = []
    for hops in range(2, max_hops + 1):
        if hops >= min_hops:
            found.append(_close(paths, _next_edges(goal)))
        if hops < max_hops:
            steps_on = _next_edges(towards(max_hops - hops))
            paths = cut_lineage(_extend(paths, steps_on))
    rings = _describe(reduce(DataFrame.unionByName, found)).drop("steps")
    return rings.orderBy(F.desc("total_amount"), "transaction_ids").limit(limit)


def ring_severity(total: Column) -> Column:
    return F.when(total > 100_000, F.lit("critical")).otherwise(F.lit("high"))


# --- chains and neighbourhoods ------------------------------------------------------------------------
def value_chains(
    edges: DataFrame, min_edges: int = 2, max_edges: int = 4, above: float = 10_000.0
) -> DataFrame:
    """Open walks whose every transfer is above the amount (filtered before any join)."""
    core = cut_lineage(_core(edges.where(F.col("amount") > above)))
    nexts = _next_edges(core)
    paths = core.select(
        F.col("src").alias("root"), F.col("dst").alias("last"),
        F.array(_step()).alias("steps"), F.col("t").alias("t_min"), F.col("t").alias("t_max"),
    )
    found = [paths] if min_edges <= 1 else []
    for n in range(2, max_edges + 1):
        paths = cut_lineage(_extend(paths, nexts))
        if n >= min_edges:
            found.append(paths)
    chains = reduce(DataFrame.unionByName, found)
    return chains.select(
        F.col("root").alias("first_account"), F.col("last").alias("last_account"),
        _ids(F.col("steps")).alias("transaction_ids"), F.size("steps").alias("edges"),
        F.aggregate("steps", F.lit(0).cast(MONEY), lambda a, s: (a + s["amount"]).cast(MONEY))
        .alias("total_amount"),
    )


def neighbourhood(edges: DataFrame, account: str, depth: int = 2, limit: int = 200) -> DataFrame:
    """Edges on undirected walks of up to ``depth`` steps from an account, newest first."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1..4")
    reached = edges.sparkSession.createDataFrame([(account,)], "node string")
    for _ in range(depth - 1):
        reached = cut_lineage(reached)
        out = edges.join(reached.select(F.col("node").alias("src")), "src", "left_semi")
        back = edges.join(reached.select(F.col("node").alias("dst")), "dst", "left_semi")
        reached = (
            reached.unionByName(out.select(F.col("dst").alias("node")))
            .unionByName(back.select(F.col("src").alias("node")))
            .distinct()
        )
    touched = touching(edges, reached.select(F.col("node").alias("iban")))
    centre = (F.col("src") == account) | (F.col("dst") == account)
    return (
        touched.withColumn("is_center", centre)
        .orderBy(F.desc("timestamp"), F.desc("transaction_id"))
        .limit(limit)
    )


def touching(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges with at least one end in ``accounts(iban)``, each once."""
    sources = accounts.select(F.col("iban").alias("src")).distinct()
    targets = accounts.select(F.col("iban").alias("dst")).distinct()
    by_source = edges.join(sources, "src", "left_semi").select(*edges.columns)
    rest = edges.join(sources, "src", "left_anti").join(targets, "dst", "left_semi")
    return by_source.unionByName(rest.select(*edges.columns))


def account_transactions(edges: DataFrame, account: str, limit: int = 100) -> DataFrame:
    """Newest sent and newest received transfers of an account; a self transfer once."""
    order = [F.desc("timestamp"), F.desc("transaction_id")]
    sent = edges.where(F.col("src") == account).orderBy(*order).limit(limit)
    got = edges.where(F.col("dst") == account).orderBy(*order).limit(limit)
    return sent.unionByName(got).distinct()


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Users, transactions and volume; all zero while there are no transfers."""
    flows = edges.agg(
        F.count("*").alias("transaction_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_volume"),
    )
    # Two one-row results side by side.
    both = nodes.agg(F.count("*").alias("n")).crossJoin(flows)
    users = F.when(F.col("transaction_count") > 0, F.col("n")).otherwise(0)
    return both.select(users.alias("user_count"), "transaction_count", "total_volume")


def recent_network(
    edges: DataFrame, as_of: Column, hours: int = 24, limit: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the newest transfers of the last hours.

    A node counts what it sent. Group 1 marks fraud, 2 an account first seen sending,
    0 one first seen receiving.
    """
    t, now = F.unix_micros("timestamp"), F.unix_micros(as_of)
    order = [F.desc("timestamp"), F.desc("transaction_id")]
    links = (
        edges.where((t > now - hours * S.HOUR_US) & (t <= now))
        .orderBy(*order)
        .limit(limit)
        .withColumn("is_fraud", S.is_fraud_mark(F.col("fraud_type")))
    )

    def end(account: str, sends: bool) -> Column:
        return F.struct(
            F.col(account).alias("iban"),
            F.struct(
                (-F.unix_micros("timestamp")).alias("t"),
                F.lit(0 if sends else 1).alias("role"),
            ).alias("seen"),
            F.lit(1 if sends else 0).alias("sent"),
            (F.col("amount") if sends else F.lit(0.0)).alias("money"),
            F.col("is_fraud"),
        )

    nodes = (
        links.select(F.inline(F.array(end("src", True), end("dst", False))))
        .groupBy("iban")
        .agg(
            F.sum("sent").alias("tx_count"),
            F.sum("money").alias("amount_total"),
            F.max("is_fraud").alias("is_fraud"),
            F.min("seen")["role"].alias("role"),
        )
    )
    group = F.when(F.col("is_fraud"), 1).when(F.col("role") == 0, 2).otherwise(0)
    return (
        nodes.select(
            "iban", S.short_label(F.col("iban")).alias("label"), "tx_count", "amount_total",
            "is_fraud", group.alias("group"),
        ),
        links,
    )


def fraud_subgraph(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fraud accounts and the links touching one of them."""
    marked = nodes.where("is_fraud")
    return marked, touching(links, marked.select("iban"))


def account_summary(edges: DataFrame) -> DataFrame:
    """Per account: transfers, counterparties and volumes in both directions."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("account"), F.col("dst").alias("other"),
                         F.col("amount").alias("sent"), F.lit(0.0).alias("got"),
                         F.lit(1).alias("n")),
                F.struct(F.col("dst").alias("account"), F.col("src").alias("other"),
                         F.lit(0.0).alias("sent"), F.col("amount").alias("got"),
                         F.when(F.col("src") == F.col("dst"), 0).otherwise(1).alias("n")),
            )
        )
    )
    # Counterparties are reduced first, so a busy account arrives as few rows.
    pairs = ends.groupBy("account", "other").agg(
        F.sum("n").alias("n"), F.sum("sent").alias("sent"), F.sum("got").alias("got")
    )
    return pairs.groupBy("account").agg(
        F.sum("n").alias("transactions"), F.count("*").alias("counterparties"),
        F.sum("sent").alias("amount_sent"), F.sum("got").alias("amount_received"),
    )


def account_activity(edges: DataFrame, account: str) -> DataFrame:
    """All transfers of one account with the other party, one row each."""
    other = F.when(F.col("src") == account, F.col("dst")).otherwise(F.col("src"))
    return edges.where((F.col("src") == account) | (F.col("dst") == account)).select(
        F.lit(account).alias("account"), other.alias("counterparty"), "transaction_id",
        "amount", "timestamp",
    )
