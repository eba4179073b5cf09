"""Rings of the whole money-flow graph: all of them, the largest, the longest.

A ring is met in the middle: one half walk leaves its busiest account, one half walk comes
back to it, and a join on both ends (and on time slices, inside a window) puts them
together. Accounts are ordered by degree and a half walk never passes an account busier
than its root, so incoming and outgoing transfers of a busy account are only multiplied
with each other between even busier ones, and each ring is met once instead of once per
member.

The largest rings need no list of all rings. For every account and number of transfers the
most that a walk from it, or to it, can carry bounds what a half walk may still become;
half walks that can't reach the total that ``limit`` known rings have are dropped. Known
rings come from the heaviest transfers. Nothing is lost: the bound only drops what could
not be among the answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.graph import MONEY, _core, _describe, _rotated
from finsieve.session import cut_lineage

#: A round of trimming that drops less than this share of the edges is the last one.
LEAST_TRIMMED = 0.01
#: Heaviest transfers searched first for known rings, and the factor of the next tries.
FIRST_HEAVY = 512
HEAVY_GROWTH = 4
#: Totals are exact decimals, bounds are doubles.
SLACK = 1e-9


# --- the part of the graph that can hold rings -----------------------------------------------
def cycle_core(edges: DataFrame) -> DataFrame:
    """Transfers between accounts that both send and receive, trimmed until little changes."""
    edges = cut_lineage(edges)
    left = edges.count()
    while left:
        senders = edges.select(F.col("src").alias("dst")).distinct()
        receivers = edges.select(F.col("dst").alias("src")).distinct()
        both = edges.join(senders, "dst", "left_semi").join(receivers, "src", "left_semi")
        edges = cut_lineage(both.select("src", "dst", "id", "t", "amount"))
        before, left = left, edges.count()
        if before - left <= LEAST_TRIMMED * before:
            break
    return edges


def _most_carried(edges: DataFrame, steps: int) -> DataFrame:
    """(node, away, home): the largest totals of walks of 0, 1, ... ``steps`` transfers from
    the account on and back to it; null where there is none."""
    both = edges.select(
        F.col("amount").cast("double").alias("carried"),
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("away"), F.col("src").alias("node"), F.col("dst").alias("next")),
                F.struct(F.lit(False).alias("away"), F.col("dst").alias("node"), F.col("src").alias("next")),
            )
        ),
    )
    # One transfer per direction and pair of accounts can be the heaviest.
    both = cut_lineage(both.groupBy("away", "node", "next").agg(F.max("carried").alias("carried")))
    level = both.groupBy("away", "node").agg(F.max("carried").alias("most"))
    levels = [level.withColumn("j", F.lit(1))]
    for j in range(2, steps + 1):
        ahead = levels[-1].select("away", F.col("node").alias("next"), F.col("most").alias("rest"))
        level = both.join(ahead, ["away", "next"]).groupBy("away", "node").agg(
            F.max(F.col("carried") + F.col("rest")).alias("most")
        )
        levels.append(cut_lineage(level.withColumn("j", F.lit(j))))

    def most(away: bool) -> Column:
        side = F.col("away") if away else ~F.col("away")
        each = [F.max(F.when(side & (F.col("j") == j), F.col("most"))) for j in range(1, steps + 1)]
        return F.array(F.lit(0.0), *each)

    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("node").agg(most(True).alias("away"), most(False).alias("home"))


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A long that grows with ``order``: runs are cut by range and sorted inside."""
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(runs.withColumn(name, F.monotonically_increasing_id()))


class Numbered:
    """A :func:`cycle_core` in numbers: accounts by (degree, name), transfers by id.

    Half walks then hold a few longs per transfer; names come back for the rings asked for.
    """

    def __init__(self, core: DataFrame, bound_hops: int | None) -> None:
        ends = core.select(F.explode(F.array("src", "dst")).alias("node"))
        facts = ends.groupBy("node").agg(F.count("*").alias("degree"))
        if bound_hops:
            facts = facts.join(_most_carried(core, bound_hops - 1), "node")
        else:
            none = F.lit(None).cast("array<double>")
            facts = facts.withColumns({"away": none, "home": none})
        self.accounts = _numbered(facts, ["degree", "node"], "number")
        self.transfers = _numbered(core, ["id"], "e")
        edges = self.transfers.select("e", "src", "dst", "t", "amount")
        for end in ("src", "dst"):
            own = self.accounts.select(
                F.col("node").alias(end), F.col("number").alias(f"_{end}"),
                F.col("away").alias(f"{end}_away"), F.col("home").alias(f"{end}_home"),
            )
            edges = edges.join(own, end).drop(end).withColumnRenamed(f"_{end}", end)
        self.edges = cut_lineage(edges)

    def described(self, rings: DataFrame) -> DataFrame:
        """The ring columns of :func:`graph._describe` for rows ``es``, ``t_min``, ``t_max``.

        Rings that share all transfers in the same order are one row each.
        """
        keyed = rings.withColumn("_ring", F.monotonically_increasing_id())
        each = keyed.select("_ring", "t_min", "t_max", F.posexplode("es").alias("pos", "e"))
        step = F.struct("src", "id", "t", "amount")
        named = each.join(self.transfers, "e").groupBy("_ring").agg(
            F.first("t_min").alias("t_min"), F.first("t_max").alias("t_max"),
            F.array_sort(F.collect_list(F.struct("pos", step.alias("step")))).alias("steps"),
        )
        return _describe(named.withColumn("steps", F.transform("steps", lambda s: s["step"])))


# --- half walks ---------------------------------------------------------------------------------
def _later(t: str, e: str) -> Column:
    """``last_e`` after a transfer (or half) that ends with ``e`` at ``t``."""
    after = (F.col(t) > F.col("t_max")) | ((F.col(t) == F.col("t_max")) & (F.col(e) > F.col("last_e")))
    return F.when(after, F.col(e)).otherwise(F.col("last_e")).alias("last_e")


class _Halves:
    """Half walks away from and back to their roots; ``tip`` is the open end."""

    def __init__(
        self, edges: DataFrame, hops: tuple[int, int], window_us: int | None, simple: bool,
        at_least: float | None,
    ) -> None:
        self.edges, self.hops, self.window_us = edges, hops, window_us
        self.simple, self.at_least = simple, at_least

    def _may_reach(self, done: int, away: bool) -> Column:
        """Whether some ring of an allowed length through this half can reach the total."""
        if self.at_least is None:
            return F.lit(True)
        start, end = ("tip_away", "root_home") if away else ("root_away", "tip_home")
        most = []
        for hops in range(max(self.hops[0], done + 1), self.hops[1] + 1):
            rest = hops - done
            # Nulls (no such walk) are passed over: another split still bounds it.
            most.append(
                F.least(
                    *[
                        F.element_at(start, a + 1) + F.element_at(end, rest - a + 1)
                        for a in range(rest + 1)
                    ]
                )
            )
        best = F.greatest(*most) if len(most) > 1 else most[0]
        return F.coalesce(self._reaches(F.col("total").cast("double") + best), F.lit(False))

    def _reaches(self, total: Column) -> Column:
        return total >= self.at_least * (1 - SLACK) - SLACK

    def _below_root(self, tip: Column, root: Column) -> Column:
        return tip < root if self.simple else tip <= root

    def _near(self, walks: DataFrame) -> DataFrame:
        at = F.floor(F.col("t_min") / self.window_us)
        return walks.select("*", F.explode(F.array(at - 1, at, at + 1)).alias("slice"))

    def _within(self, low: str, high: str) -> Column:
        if self.window_us is None:
            return F.lit(True)
        return F.greatest("t_max", high) - F.least("t_min", low) < self.window_us

    def first(self, away: bool) -> DataFrame:
        root, tip = ("src", "dst") if away else ("dst", "src")
        ok = self._below_root(F.col(tip), F.col(root))
        return self.edges.where(ok).select(
            F.col(root).alias("root"), F.col(f"{root}_away").alias("root_away"),
            F.col(f"{root}_home").alias("root_home"), F.col(tip).alias("tip"),
            F.col(f"{tip}_away").alias("tip_away"), F.col(f"{tip}_home").alias("tip_home"),
            F.array("e").alias("es"), F.array("src").alias("srcs"), F.col("amount").alias("total"),
            F.col("t").alias("t_min"), F.col("t").alias("t_max"), F.col("e").alias("last_e"),
        ).where(self._may_reach(1, away))

    def longer(self, walks: DataFrame, away: bool, done: int) -> DataFrame:
        """One more transfer at the tip. Inside a window the join also runs on time slices,
        which spreads a busy account over many tasks."""
        joint, tip = ("src", "dst") if away else ("dst", "src")
        nexts = self.edges.select(*[F.col(c).alias(f"n_{c}") for c in self.edges.columns])
        on = F.col("tip") == F.col(f"n_{joint}")
        if self.window_us is not None:
            walks = self._near(walks)
            nexts = nexts.withColumn("n_slice", F.floor(F.col("n_t") / self.window_us))
            on &= F.col("slice") == F.col("n_slice")
        ok = self._below_root(F.col(f"n_{tip}"), F.col("root")) & self._within("n_t", "n_t")
        ok &= ~F.array_contains("es", F.col("n_e"))
        if self.simple:
            ok &= ~F.array_contains("srcs", F.col(f"n_{tip}")) & (F.col(f"n_{tip}") != F.col("tip"))

        def joined(held: str, new: str) -> Column:
            one = F.array(new)
            return (F.concat(held, one) if away else F.concat(one, F.col(held))).alias(held)

        return walks.join(nexts, on).where(ok).select(
            "root", "root_away", "root_home", F.col(f"n_{tip}").alias("tip"),
            F.col(f"n_{tip}_away").alias("tip_away"), F.col(f"n_{tip}_home").alias("tip_home"),
            joined("es", "n_e"), joined("srcs", "n_src"),
            (F.col("total") + F.col("n_amount")).cast(MONEY).alias("total"),
            F.least("t_min", "n_t").alias("t_min"), F.greatest("t_max", "n_t").alias("t_max"),
            _later("n_t", "n_e"),
        ).where(self._may_reach(done + 1, away))

    def met(self, away: DataFrame, home: DataFrame) -> DataFrame:
        """Rings of two halves with the same root and the same open end."""
        held = ("root", "tip", "es", "srcs", "total", "t_min", "t_max", "last_e")
        away = away.select(*held)
        back = home.select(*[F.col(c).alias(f"b_{c}") for c in held])
        on = (F.col("root") == F.col("b_root")) & (F.col("tip") == F.col("b_tip"))
        if self.window_us is not None:
            away = self._near(away)
            back = back.withColumn("b_slice", F.floor(F.col("b_t_min") / self.window_us))
            on &= F.col("slice") == F.col("b_slice")
        total = (F.col("total") + F.col("b_total")).cast(MONEY)
        ok = ~F.arrays_overlap("es", "b_es") & self._within("b_t_min", "b_t_max")
        if self.simple:
            ok &= ~F.arrays_overlap("srcs", "b_srcs")
        if self.at_least is not None:
            ok &= self._reaches(total.cast("double"))
        return away.join(back, on).where(ok).select(
            "root", F.concat("es", "b_es").alias("es"), F.concat("srcs", "b_srcs").alias("srcs"),
            total.alias("total"),
            F.least("t_min", "b_t_min").alias("t_min"), F.greatest("t_max", "b_t_max").alias("t_max"),
            _later("b_t_max", "b_last_e"),
        )


def closed_walks(
    graph: Numbered, min_hops: int, max_hops: int, window_us: int | None, simple: bool,
    at_least: float | None,
) -> DataFrame:
    """Every ring once, in numbers: es and srcs from its smallest transfer on, total, the first
    and last time, and the transfer that came last (by time, then id)."""
    halves = _Halves(graph.edges, (min_hops, max_hops), window_us, simple, at_least)
    away, home = {1: halves.first(True)}, {1: halves.first(False)}
    for n in range(2, (max_hops + 1) // 2 + 1):
        away[n] = cut_lineage(halves.longer(away[n - 1], True, n - 1))
    for n in range(2, max_hops // 2 + 1):
        home[n] = cut_lineage(halves.longer(home[n - 1], False, n - 1))
    rings = reduce(
        DataFrame.unionByName,
        [halves.met(away[(h + 1) // 2], home[h // 2]) for h in range(min_hops, max_hops + 1)],
    )
    # A walk through its busiest account twice has two starts there: keep one.
    starts = F.filter("es", lambda e, i: F.get("srcs", i) == F.col("root"))
    rings = rings.where(F.array_min(starts) == F.get("es", F.lit(0)))
    first = F.array_position("es", F.array_min("es")).cast("int")
    return rings.select(
        _rotated(F.col("es"), first).alias("es"), _rotated(F.col("srcs"), first).alias("srcs"),
        "total", "t_min", "t_max", "last_e",
    )


def _checked(min_hops: int, max_hops: int) -> None:
    if not 2 <= min_hops <= max_hops:
        raise ValueError("2 <= min_hops <= max_hops is required")


def _window(window_hours: float | None) -> int | None:
    return None if window_hours is None else int(window_hours * S.HOUR_US)


# --- all, largest, longest ------------------------------------------------------------------------
def find_rings(
    edges: DataFrame, min_hops: int = 3, max_hops: int = 5, window_hours: float | None = None,
    simple: bool = False,
) -> DataFrame:
    """Every ring once, started at its smallest transaction id.

    ``window_hours`` keeps rings whose first and last transfer are less than that
    apart. ``simple`` forbids repeated accounts. The number of rings grows with the
    degree to the power of the hops; without a window ask for the largest instead.
    """
    _checked(min_hops, max_hops)
    graph = Numbered(cycle_core(_core(edges)), None)
    rings = closed_walks(graph, min_hops, max_hops, _window(window_hours), simple, None)
    return graph.described(cut_lineage(rings))


def _order() -> list[Column]:
    """Largest first; equal totals by the transactions as a set, then by their order on the ring."""
    return [F.desc("total_amount"), F.array_sort("transaction_ids"), F.col("transaction_ids")]


def largest_of(
    core: DataFrame, min_hops: int, max_hops: int, limit: int, min_amount: float,
    window_us: int | None, simple: bool,
) -> DataFrame:
    """The ``limit`` largest rings of a :func:`cycle_core` with at least ``min_amount``."""
    n = core.count()

    def rings(part: DataFrame, at_least: float | None) -> tuple[Numbered, DataFrame]:
        graph = Numbered(part, None if at_least is None else max_hops)
        found = closed_walks(graph, min_hops, max_hops, window_us, simple, at_least)
        enough = F.col("total") >= F.lit(min_amount).cast(MONEY)
        # Numbers of transfers are in the order of their ids.
        order = [F.desc("total"), F.array_sort("es"), F.col("es")]
        return graph, found.where(enough).orderBy(*order).limit(limit)

    def known(size: int, at_least: float | None) -> tuple[int, float]:
        """How many rings the ``size`` heaviest transfers hold (at most ``limit``), least total."""
        cut = core.agg(F.percentile_approx("amount", F.lit(1 - size / n), 100_000)).first()[0]
        _, found = rings(core.where(F.col("amount") >= F.lit(cut)), at_least)
        count, least = found.agg(F.count("*"), F.min("total")).first()
        return count, float(least or 0)

    at_least, size, tries = float(min_amount), FIRST_HEAVY, 0
    while size * HEAVY_GROWTH < n and tries < 2:
        # The first few transfers need no bound.
        count, least = known(size, at_least if tries else None)
        if count == limit:
            # One more try with more transfers makes the bound sharper.
            at_least, tries = max(at_least, least), tries + 1
        size *= HEAVY_GROWTH
    graph, found = rings(core, at_least)
    return graph.described(cut_lineage(found))


def all_rings(
    edges: DataFrame, min_hops: int = 3, max_hops: int = 5, min_amount: float = 1000.0,
    limit: int = 50, dedupe: bool = True, window_hours: float | None = None, simple: bool = False,
) -> DataFrame:
    """The ``limit`` largest rings of the whole graph with at least ``min_amount``.

    Without ``dedupe`` every ring appears once per starting account. The limit only cuts
    the result: every transfer may take part in a ring.
    """
    _checked(min_hops, max_hops)
    core = cycle_core(_core(edges))
    # Every ring stands in at least min_hops rows when it is listed once per start.
    needed = limit if dedupe else -(-limit // min_hops)
    rings = largest_of(core, min_hops, max_hops, needed, min_amount, _window(window_hours), simple)
    if dedupe:
        return rings.orderBy(*_order()).drop("steps")
    spun = rings.select(
        F.col("first_us").alias("t_min"), F.col("last_us").alias("t_max"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("steps")),
                lambda i: _rotated(F.col("steps"), i),
            )
        ).alias("steps"),
    )
    return _describe(spun).orderBy(*_order()).limit(limit).drop("steps")


def longest_rings(
    edges: DataFrame, as_of: Column, min_hops: int = 3, max_hops: int = 6, days: int = 7,
    limit: int = 100, simple: bool = False,
) -> DataFrame:
    """Rings of the last days, longest first, then largest first.

    Shorter rings are only searched while the longer ones leave places.
    """
    _checked(min_hops, max_hops)
    now = F.unix_micros(as_of)
    recent = _core(edges).where((F.col("t") > now - days * S.DAY_US) & (F.col("t") <= now))
    core = cycle_core(recent)
    found, left = [], limit
    for hops in range(max_hops, min_hops - 1, -1):
        rings = cut_lineage(largest_of(core, hops, hops, left, 0.0, None, simple))
        found.append(rings)
        left -= rings.count()
        if not left:
            break
    rings = reduce(DataFrame.unionByName, found)
    return rings.orderBy(F.desc("hops"), *_order()).drop("steps")


# --- the largest ring of an account at a moment ---------------------------------------------------
#: Cells of time per window.
CELLS = 256
#: Slices of all time, and the share of the rings ending in one that are not tried first.
SLICES = 64
LARGE = 0.98


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """Aligned power-of-two blocks of cells that together cover [low, high) exactly."""

    def at(level: int) -> list[Column]:
        size = 1 << level
        lo = F.floor((low + (size - 1)) / size).cast("long")
        hi = F.floor(high / size).cast("long")
        some = lo < hi

        def block(number: Column) -> Column:
            return F.struct(F.lit(level).alias("level"), number.alias("block"))

        return [
            F.when(some & (lo % 2 == 1), block(lo)), F.when(some & (hi % 2 == 1), block(hi - 1)),
        ]

    return F.array_compact(F.array(*[c for level in range(levels) for c in at(level)]))


def _promising(rings: DataFrame, best: DataFrame, low: int, slice_us: int) -> DataFrame:
    """Members (number, total, t_max, t_min, last_e) of rings that may beat what is known.

    ``best(number, t, total)`` has a row per moment. For every account and slice of time the
    least known total is kept; a member stays if its total reaches that of some slice in
    which the ring counts.
    """
    at = F.floor((F.col("t") - low) / slice_us).cast("int")
    least = best.groupBy("number", at.alias("slice")).agg(
        F.min(F.coalesce(F.col("total").cast("double"), F.lit(-1.0))).alias("least")
    )
    # Slices without a moment of the account ask for nothing; their least is never reached.
    each = F.map_from_entries(F.collect_list(F.struct("slice", "least")))
    none = F.lit(float("inf"))
    held = least.groupBy("number").agg(each.alias("least")).select(
        "number",
        F.transform(
            F.sequence(F.lit(0), F.lit(SLICES - 1)),
            lambda i: F.coalesce(F.try_element_at("least", i), none),
        ).alias("least"),
    )
    members = rings.select(
        F.explode(F.array_distinct("srcs")).alias("number"), "total", "t_max", "t_min", "last_e", "end"
    )
    first = F.floor((F.col("t_max") - low) / slice_us).cast("int")
    last = F.least(F.floor((F.col("end") - low) / slice_us).cast("int"), F.lit(SLICES - 1))
    to_beat = F.array_min(F.slice("least", first + 1, last - first + 1))
    return members.join(held, "number").where(
        F.col("total").cast("double") * (1 + SLACK) >= to_beat
    ).drop("least")


def largest_at(graph: Numbered, rings: DataFrame, moments: DataFrame, window_us: int) -> DataFrame:
    """``moments(account, transaction_id, t)`` with the largest ring of the account at that time.

    A ring counts for its accounts from its last transfer (that transfer's id on, at the
    same microsecond) until its first one leaves the window. The rings that are large for
    their time answer most moments; what they leave is looked up among the members that
    may still beat them. Adds total, path (start first, each account once per step), ids.
    """
    rings = cut_lineage(rings.withColumn("end", F.col("t_min") + window_us))
    asked = cut_lineage(
        moments.join(graph.accounts.select(F.col("node").alias("account"), "number"), "account")
    )
    key = ["number", "transaction_id", "t"]
    low, high = rings.agg(F.min("t_max"), F.max("end")).first()
    if low is None:
        low, high = 0, 0
    slice_us = (high - low) // SLICES + 1
    ends_in = F.floor((F.col("t_max") - low) / slice_us)
    large = rings.groupBy(ends_in.alias("slice")).agg(
        F.percentile_approx("total", F.lit(LARGE), 1000).alias("large")
    )
    some = rings.withColumn("slice", ends_in).join(large, "slice").where(F.col("total") >= F.col("large"))
    members = some.select(
        F.explode(F.array_distinct("srcs")).alias("number"), "total", "t_max", "t_min", "last_e", "end"
    )
    known = _totals_at(graph, members, asked, window_us)
    # A moment before all rings, or after them, has none.
    inside = asked.where((F.col("t") >= low) & (F.col("t") < high))
    known = cut_lineage(inside.join(known, key, "left").select("number", "t", "total"))
    rest = cut_lineage(_promising(rings, known, low, slice_us))
    best = cut_lineage(_totals_at(graph, rest, asked, window_us))

    # The rings with those totals; of equal ones the last by ids.
    wanted = rings.join(best.select("total").distinct(), "total", "left_semi")
    starts = wanted.select("*", F.posexplode("srcs").alias("pos", "number"))
    last_ids = graph.transfers.select(F.col("e").alias("last_e"), F.col("id").alias("last_id"))
    chosen = (
        starts.join(best, ["number", "total"])
        .where((F.col("t") >= F.col("t_max")) & (F.col("t") < F.col("end")))
        .join(last_ids, "last_e")
        .where((F.col("t") > F.col("t_max")) | (F.col("transaction_id") >= F.col("last_id")))
        .groupBy(*key, "total")
        .agg(F.max(_rotated(F.col("es"), F.col("pos") + 1)).alias("es"))
    )
    step = F.struct("pos", "src", "id").alias("step")
    named = (
        chosen.select(*key, "total", F.posexplode("es").alias("pos", "e"))
        .join(graph.transfers.select("e", "src", "id"), "e")
        .groupBy(*key, "total").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    )
    return named.join(asked, key).select(
        "account", "transaction_id", "t", "total",
        F.transform("steps", lambda s: s["src"]).alias("path"),
        F.transform("steps", lambda s: s["id"]).alias("ids"),
    )


def _totals_at(graph: Numbered, spans: DataFrame, asked: DataFrame, window_us: int) -> DataFrame:
    """number, transaction_id, t, total: the largest total of ``spans`` at the moments asked.

    A span is a run of whole cells of time, covered by aligned power-of-two blocks, between
    two ragged cells. The largest total of an account and block is a partial aggregate
    over longs; a moment looks into the blocks that hold it and compares itself with the
    ragged spans of its own cell. So no account meets all its rings in one place.
    """
    key = ["number", "transaction_id", "t"]
    cell = max(1, window_us // CELLS)
    levels = (CELLS + 1).bit_length() + 1

    def cell_of(t: Column) -> Column:
        return F.floor(t / cell).cast("long")

    asked = asked.withColumn("cell", cell_of(F.col("t")))
    whole = spans.groupBy(
        "number", (cell_of(F.col("t_max")) + 1).alias("low"), cell_of(F.col("end")).alias("high")
    ).agg(F.max("total").alias("total"))
    blocks = whole.select(
        "number", "total", F.inline(_blocks(F.col("low"), F.col("high"), levels))
    ).groupBy("number", "level", "block").agg(F.max("total").alias("total"))
    holding = F.array(
        *[
            F.struct(F.lit(k).alias("level"), F.floor(F.col("cell") / (1 << k)).cast("long").alias("block"))
            for k in range(levels)
        ]
    )
    inside = asked.select(*key, F.inline(holding)).join(blocks, ["number", "level", "block"])

    ends = F.array_distinct(F.array(cell_of(F.col("t_max")), cell_of(F.col("end"))))
    ragged = spans.select("*", F.explode(ends).alias("cell")).join(asked, ["number", "cell"]).where(
        (F.col("t") > F.col("t_max")) & (F.col("t") < F.col("end"))
    )
    last_ids = graph.transfers.select(F.col("e").alias("last_e"), F.col("id").alias("last_id"))
    at_once = spans.withColumnRenamed("t_max", "t").join(asked, ["number", "t"]).groupBy(
        *key, "last_e"
    ).agg(F.max("total").alias("total")).join(last_ids, "last_e").where(
        F.col("transaction_id") >= F.col("last_id")
    )
    parts = [p.select(*key, "total") for p in (inside, ragged, at_once)]
    return reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.max("total").alias("total"))
