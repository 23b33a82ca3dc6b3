"""Filter interaction audit by forward-backward path counting over the subset lattice.

Filters are applied one after another; what a filter removes depends on those before it.  The
states of the process are the subsets of filters that have been applied, and an order of ``k``
filters is a path from the empty to the whole set.

1. One scan turns every row into a mask of the filters it fails.  Rows are counted by part and
   mask: at most ``2^k`` cells a part, added up on the map side.
2. An edge of the lattice applies one more filter ``f`` to a state ``S``.  It removes the rows that
   fail ``f`` and nothing in ``S``: a sum over the cells.
3. ``orders_in(S)`` counts the paths that reach a state, ``orders_out(S)`` those that leave it for the
   end; both by one sweep over the lattice.  ``orders_in(S) * orders_out(S + f)`` orders use an edge.
   Weighted by it, the removals of a filter's edges add up to its Shapley total over all orders.
4. The steps of every order are read from the same edges.

The lattice has ``k * 2^(k-1)`` edges and ``k!`` orders (80 and 120 for five filters), whatever the
table; cells and edges meet in a projection, one row a part, so nothing is joined or collected.

Defined results: an empty table gives no rows; a null part is the empty string; a condition that is
null counts as passed; columns with clashing names do no harm.
:func:`first_holders` settles "equal to an earlier row's text": a row without an id is never a copy
and never an original; rows that repeat the smallest id of a text are all originals.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More filters would give more than 40,320 orders a part.
MAX_FILTERS = 8


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Per state (bit mask of applied filters): the orders that reach it and those that leave it."""
    full = (1 << k) - 1
    into, out = [0] * (full + 1), [0] * (full + 1)
    into[0] = out[full] = 1
    for state in range(1, full + 1):          # every smaller state comes before
        into[state] = sum(into[state ^ (1 << f)] for f in range(k) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        out[state] = sum(out[state | (1 << f)] for f in range(k) if not state >> f & 1)
    return into, out


def edges(k: int) -> list[tuple[int, int, int]]:
    """``(state, filter, orders through the edge)``, by state, then filter."""
    into, out = path_counts(k)
    return [(s, f, into[s] * out[s | (1 << f)]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def fail_mask(conditions: list[Column]) -> Column:
    """Bit ``i`` is set where condition ``i`` holds (the row fails filter ``i``)."""
    mask = F.lit(0)
    for i, c in enumerate(conditions):
        mask = mask + F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def cells(rows: DataFrame, part: Column, mask: Column, weights: dict[str, Column] | None = None,
          n: Column | None = None) -> DataFrame:
    """``part, mask, n`` and one sum for each of ``weights``: the counts all else is read from.
    ``n`` is how many rows a row stands for."""
    n = F.lit(1) if n is None else n
    return rows.groupBy(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask")).agg(
        F.sum(n.cast("long")).alias("n"), *[F.sum(w.cast("long")).alias(c) for c, w in (weights or {}).items()])


def audit(counts: DataFrame, names: str, lost: list[str] | None = None) -> DataFrame:
    """From :func:`cells`: one row per part, order and step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails``, a ``<name>_lost`` for each
    of ``lost`` (rows of that weight removed at the step) and ``shapley``.  ``names`` has one letter
    a filter, in the order of the mask's bits."""
    k, lost = len(names), lost or []
    if not 1 <= k <= MAX_FILTERS or len(set(names)) != k:
        raise ValueError(f"1 to {MAX_FILTERS} filters with different letters, not {names!r}")
    lattice = edges(k)
    at = {(s, f): i for i, (s, f, _) in enumerate(lattice)}
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *lost)).alias("cells"))  # at most 2^k

    def total(cells: Column, keep, field: str = "n") -> Column:
        return F.aggregate(F.filter(cells, keep), F.lit(0).cast("long"), lambda a, c: a + c[field])

    def edge(e: Column) -> Column:
        bit, state, here = e["bit"], e["state"], F.col("cells")
        gone = lambda c: ((c["mask"].bitwiseAND(bit)) != 0) & (c["mask"].bitwiseAND(state) == 0)
        earlier = lambda c: ((c["mask"].bitwiseAND(bit)) != 0) & (c["mask"].bitwiseAND(state) != 0)
        left = lambda c: c["mask"].bitwiseAND(state.bitwiseOR(bit)) == 0
        return F.struct(e["bit"].alias("bit"), e["orders"].alias("orders"), total(here, left).alias("kept"),
                        total(here, gone).alias("removed"), total(here, earlier).alias("redundant"),
                        total(here, lambda c: c["mask"] == bit).alias("unique_fails"),
                        *[total(here, gone, c).alias(f"{c}_lost") for c in lost])

    plan = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("orders"))
                     for s, f, w in lattice])
    swept = parts.select("part", F.transform(plan, edge).alias("edges"))

    def shapley(bit: int) -> Column:
        mine = F.filter("edges", lambda e: e["bit"] == bit)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, e: a + e["removed"] * e["orders"])

    shares = [shapley(1 << f) for f in range(k)]
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order):
            steps.append((''.join(names[g] for g in order), step + 1, at[state, f], f))
            state |= 1 << f
    walk = constant_steps(steps)
    # constant steps (k! * k rows) and one row a part: the steps are unfolded in the parts' rows
    return (swept.withColumn("shares", F.array(*shares)).select("part", "edges", "shares", F.explode(walk).alias("s"))
            .select("part", F.col("s.filter_order"), F.col("s.step"), F.get("edges", F.col("s.edge")).alias("e"),
                    F.get("shares", F.col("s.filter")).alias("shapley"))
            .select("part", "filter_order", "step", "e.kept", "e.removed", "e.redundant", "e.unique_fails",
                    *[f"e.{c}_lost" for c in lost], "shapley"))


def constant_steps(steps: list[tuple[str, int, int, int]]) -> Column:
    """The steps of all orders as one constant array, written as text and parsed once a row."""
    text = ";".join(",".join(map(str, s)) for s in steps)
    field = lambda x, i: F.get(F.split(x, ","), F.lit(i))
    return F.transform(F.split(F.lit(text), ";"), lambda x: F.struct(
        field(x, 0).alias("filter_order"), field(x, 1).cast("int").alias("step"),
        field(x, 2).cast("int").alias("edge"), field(x, 3).cast("int").alias("filter")))


def first_holders(rows: DataFrame, digest: str, id_col: str, out: str) -> DataFrame:
    """``rows`` with a flag: an earlier id has the same digest.

    The smallest id of each digest is found by an aggregate (copies collapse on the map side), then
    looked up by digest and id together, so the rows of a hot digest spread over all tasks."""
    first = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min(id_col).alias("__first"))
    same = (F.col(digest) == F.col("__d")) & (F.col(id_col) == F.col("__first"))
    return rows.join(first, same, "left").withColumn(
        out, F.col(id_col).isNotNull() & F.col("__first").isNull()).drop("__d", "__first")
