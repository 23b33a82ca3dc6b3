"""The tree trainer against plain Python, its two ways of growing against each other, and models with a
known accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pertinax.operators import ensembles as E
from pertinax.operators import trees as T

FOREST = T.TreeSpec("forest", 12, 6, 2, 1, seed=7)


def table(n=80, p=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 9, (n, p)).astype(np.uint8), rng.integers(0, 2, n).astype(float), rng.choice([0.5, 1.0, 2.0], n)


def gini(a, b):
    return (a + b) * (1 - (a * a + b * b) / (a + b) ** 2) if a + b else 0.0


def brute_split(x, a, b, spec, score):
    """The best (gain, feature, bin), by trying all."""
    best = None
    for f, cut in itertools.product(range(x.shape[1]), range(9)):
        left = x[:, f] <= cut
        if min(left.sum(), (~left).sum()) < max(spec.min_leaf, 1):
            continue
        g = score(a[left].sum(), b[left].sum(), a[~left].sum(), b[~left].sum())
        if g > 1e-9 and (best is None or g > best[0] + 1e-9):
            best = (g, f, cut)
    return best


def walk(nodes, x, a, b, spec, score, leaf):
    """Every split of a grown tree is the best there is, every leaf has none or may not be split."""
    rows = {1: np.arange(len(x))}
    for k in np.argsort(nodes.node):
        node, mine = int(nodes.node[k]), rows[int(nodes.node[k])]
        assert nodes.n[k] == len(mine)
        assert nodes.value[k] == pytest.approx(leaf(a[mine].sum(), b[mine].sum()))
        depth = node.bit_length() - 1
        pure = spec.kind == "forest" and min(a[mine].sum(), b[mine].sum()) <= 0
        want = None if depth >= spec.depth or len(mine) < max(spec.min_split, 2) or pure else brute_split(x[mine], a[mine], b[mine], spec, score)
        if want is None:
            assert nodes.feature[k] == -1
            continue
        f, cut = nodes.feature[k], nodes.bin[k]
        left = x[mine, f] <= cut
        got = score(a[mine][left].sum(), b[mine][left].sum(), a[mine][~left].sum(), b[mine][~left].sum())
        assert got == pytest.approx(want[0])
        rows[2 * node], rows[2 * node + 1] = mine[left], mine[~left]
    assert sum(len(rows[int(n)]) for n, f in zip(nodes.node, nodes.feature) if f < 0) == len(x)


@pytest.mark.parametrize("min_split,min_leaf", [(2, 1), (10, 1), (2, 6), (25, 4)])
def test_forest_splits_are_the_best(min_split, min_leaf):
    x, y, w = table()
    spec = T.TreeSpec("forest", 1, 5, min_split, min_leaf, node_columns=1.0)
    a, b = w * (y == 0), w * (y == 1)
    score = lambda la, lb, ra, rb: gini(la + ra, lb + rb) - gini(la, lb) - gini(ra, rb)
    walk(T.grow(x, a, b, spec, 0), x, a, b, spec, score, lambda s, t: t / (s + t))


@pytest.mark.parametrize("l2,l1,gamma,hessian", [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0.7, 0, 0), (2.5, 0.3, 0.4, 0.5)])
def test_boosting_gains_with_penalties(l2, l1, gamma, hessian):
    x, y, _ = table(seed=3)
    q = np.random.default_rng(1).uniform(0.1, 0.9, len(y))
    g, h = q - y, q * (1 - q)
    spec = T.TreeSpec("boost", 1, 4, 2, 1, step=0.1, l2=l2, l1=l1, min_gain=gamma, min_hessian=hessian)

    def term(s, t):
        s = max(abs(s) - l1, 0)
        return s * s / (t + l2)

    def score(la, lb, ra, rb):
        if min(lb, rb) < hessian:
            return -1.0
        return 0.5 * (term(la, lb) + term(ra, rb) - term(la + ra, lb + rb)) - gamma

    def leaf(s, t):
        return -0.1 * np.sign(s) * max(abs(s) - l1, 0) / (t + l2)

    walk(T.grow(x, g, h, spec, 0), x, g, h, spec, score, leaf)


def test_columns_per_tree_and_node():
    spec = T.TreeSpec("boost", tree_columns=0.5, seed=5)
    for tree in range(20):
        drawn = T.columns(spec, tree, np.array([1, 2, 3]), 10)
        assert drawn.shape == (3, 5) and (drawn == drawn[0]).all() and len(set(drawn[0])) == 5
    assert len({tuple(T.columns(spec, t, np.array([1]), 10)[0]) for t in range(20)}) > 10
    per_node = T.columns(T.TreeSpec("forest", tree_columns=0.5), 3, np.arange(1, 200), 36)
    assert per_node.shape == (199, 4) and len(np.unique(per_node)) == 18
    x, y, w = table(300, 10)
    grown = T.grow(x, w * (y == 0), w * (y == 1), T.TreeSpec("forest", depth=8, tree_columns=0.3, min_split=2, min_leaf=1), 1)
    assert len(set(grown.feature[grown.feature >= 0])) <= 3


def test_draws_are_poisson_and_repeat():
    rows = np.arange(200_000)
    d = T.draws(rows, FOREST, 3)
    assert d.mean() == pytest.approx(1, abs=0.01) and (d == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert (d == T.draws(rows, FOREST, 3)).all() and (d != T.draws(rows, FOREST, 4)).mean() > 0.5
    assert T.draws(rows, T.TreeSpec("boost", subsample=0.8), 1).mean() == pytest.approx(0.8, abs=0.01)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(
        F.col("id").alias("row_id"), ((F.col("id") * 37) % 100).cast("double").alias("x1"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 11) % 50).cast("double").alias("x2"),
        ((F.col("id") * 7919) % 13).cast("double").alias("noise"), (F.col("id") % 2).cast("double").alias("flag"),
        F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("kind"),
        (F.col("id") % 3).cast("int").alias("fold"))
    return df.withColumn("label", ((F.col("x1") > 60) | ((F.col("kind") == "a") & (F.col("x1") > 30))).cast("double")) \
        .withColumn("label", F.coalesce("label", F.lit(0.0))).repartition(5).cache()


def features(rows):
    return E.Features(["x1", "x2", "noise"], ["flag"], E.categories(rows, ["kind"]))


def nodes(model, spark):
    return sorted((r["tree"] - model.first, r["node"], r["feature"], r["bin"], round(r["bound"], 9), round(r["value"], 9), r["n"])
                  for r in model.nodes(spark).collect())


def accuracy(model, df):
    return model.transform(df).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


BOOST = T.TreeSpec("boost", 8, 4, 2, 1, step=0.5, subsample=0.8, tree_columns=0.8, l2=1.0)


def test_models_learn_a_known_rule(spark, rows):
    train, test = rows.where("row_id % 5 <> 0"), rows.where("row_id % 5 = 0")
    m = E.fit(train, features(rows), [E.Member("f", T.TreeSpec("forest", 60, 10, node_columns=0.7)), E.Member("b", BOOST)],
              F.col("row_id"))
    assert accuracy(m["f"], test) >= 0.97 and accuracy(m["b"], test) >= 0.97
    p = m["f"].transform(test).select(vector_to_array("probability").alias("p"))
    assert p.where((F.abs(F.get("p", F.lit(0)) + F.get("p", F.lit(1)) - 1) > 1e-9)).count() == 0


def test_upper_levels_equal_local_growth(spark, rows, monkeypatch):
    members = [E.Member("f", FOREST), E.Member("b", BOOST), E.Member("g", T.TreeSpec("boost", 5, 3, 2, 1, step=0.3))]
    whole = E.fit(rows, features(rows), members, F.col("row_id"))
    monkeypatch.setattr(E, "LOCAL_ROWS", 120)
    monkeypatch.setattr(E, "GROUP_ROWS", 900 * 5)
    monkeypatch.setattr(E, "JOB_NODES", 7)
    monkeypatch.setattr(E, "REWRITE", 3)
    parts = E.fit(rows, features(rows), members, F.col("row_id"))
    for name in ("f", "b", "g"):
        assert nodes(parts[name], spark) == nodes(whole[name], spark), name
    assert len(parts["f"].sent(spark)) > 1                     # several groups, several broadcasts


def test_growth_does_not_depend_on_partitions(spark, rows):
    a, b = (E.fit(rows.repartition(n), features(rows), [E.Member("f", FOREST)], F.col("row_id"))["f"] for n in (1, 7))
    assert nodes(a, spark) == nodes(b, spark)


def test_a_fold_is_not_seen(spark, rows):
    members = [E.Member(f"fold{i}", FOREST, without=i) for i in range(3)] + [E.Member("b1", BOOST, without=1)]
    a = E.fit(rows, features(rows), members, F.col("row_id"), fold="fold")
    flipped = rows.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    b = E.fit(flipped, features(rows), members, F.col("row_id"), fold="fold")
    assert nodes(a["fold1"], spark) == nodes(b["fold1"], spark) and nodes(a["b1"], spark) == nodes(b["b1"], spark)
    assert nodes(a["fold0"], spark) != nodes(b["fold0"], spark)
    scored = E.score_each(rows, [a[f"fold{i}"] for i in range(3)], F.col("fold")).where("fold = 2")
    alone = scored.join(a["fold2"].transform(rows.where("fold = 2")).select(
        "row_id", vector_to_array("probability")[1].alias("p")), "row_id")
    assert alone.where(F.abs(F.col("p") - F.col("p_pert")) > 1e-12).count() == 0 and alone.count() == 300


def test_saved_model_scores_alike(spark, rows, tmp_path):
    m = E.fit(rows, features(rows), [E.Member("x", FOREST), E.Member("b", BOOST, weighted=True)], F.col("row_id"), weight="x1")
    for name in ("x", "b"):
        m[name].save(spark, f"file:{tmp_path}/{name}")
        again = E.Ensemble.load(spark, f"file:{tmp_path}/{name}")
        one, two = (k.transform(rows).orderBy("row_id").select(vector_to_array("probability")[1]).collect() for k in (m[name], again))
        assert one == two


def test_missing_and_odd_values(spark, rows):
    odd = rows.withColumns({"x2": F.lit(None).cast("double"), "noise": F.lit(float("nan")), "kind": F.lit(None).cast("string"),
                            "flag": F.when(F.col("row_id") < 3, float("inf")).otherwise(1.0)})
    m = E.fit(odd, E.Features(["x1", "x2", "noise"], ["flag"], {"kind": []}), [E.Member("f", FOREST)], F.col("row_id"))["f"]
    assert accuracy(m, odd) > 0.8
    empty = rows.limit(0)
    assert m.transform(empty.withColumn("kind", F.lit("zzz"))).count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        E.fit(empty, features(rows), [E.Member("f", FOREST)], F.col("row_id"))
    with pytest.raises(ValueError, match="levels"):
        E.fit(rows, features(rows), [E.Member("f", T.TreeSpec(depth=99))], F.col("row_id"))
    one_class = E.fit(rows.withColumn("label", F.lit(1.0)), features(rows), [E.Member("f", FOREST), E.Member("b", BOOST)], F.col("row_id"))
    assert accuracy(one_class["f"], rows.withColumn("label", F.lit(1.0))) == 1.0
    assert accuracy(one_class["b"], rows.withColumn("label", F.lit(1.0))) == 1.0


def test_one_weight_a_class_gives_the_same_tree(monkeypatch):
    """Sums added up as one number, and those of any weights."""
    x, y, _ = table(3000, 12, 4)
    x[:, 5:] %= 2
    d = T.draws(np.arange(3000), FOREST, 1)
    x, y, d = x[d > 0], y[d > 0], d[d > 0]
    a, b = 0.75 * d * (y == 0), 1.25 * d * (y == 1)
    assert T._units(a, b) is not None and T._units(a, b * np.linspace(1, 2, len(b))) is None
    fast = T.grow(x, a, b, T.TreeSpec(depth=12), 3)
    monkeypatch.setattr(T, "_units", lambda *_: None)
    slow = T.grow(x, a, b, T.TreeSpec(depth=12), 3)
    assert len(fast.node) > 200 and all((getattr(fast, c) == getattr(slow, c)).all() for c in ("node", "feature", "bin", "value", "n"))


@pytest.mark.parametrize("p,unit,most", [(12, 1.0, 9), (12, 1.25, 9), (70, 1.0, 32), (3, 1.0, 40)])
def test_large_nodes_of_a_forest_are_read_by_themselves(monkeypatch, p, unit, most):
    """They give the nodes that growing level by level gives; only small nodes are left to it."""
    rng = np.random.default_rng(p)
    x = rng.integers(0, 32, (9000, p)).astype(np.uint8)
    x[:, 2:p // 2] %= 2
    y = (x[:, 0] > 11) ^ (rng.random(9000) < 0.2)
    rows = np.flatnonzero(np.arange(9000) % 4)
    d = rng.integers(1, 4, len(rows)).astype(float)
    d[0] = most
    a, b, spec = unit * d * ~y[rows], d * y[rows], T.TreeSpec(depth=14, min_leaf=3)
    sizes, split = [], T._split
    monkeypatch.setattr(T, "_split", lambda *args: sizes.append(args[9].max()) or split(*args))
    fast = T.grow(x, a, b, spec, 3, rows=rows, bits=T.Bits(x))
    alone = T.grow(x[rows], a, b, spec, 3)
    assert max(sizes) <= T.NODE_ROWS or most > 32          # a row that counts so often leaves no room in the sums
    monkeypatch.setattr(T, "NODE_ROWS", len(rows))
    slow = T.grow(x[rows], a, b, spec, 3)
    assert len(slow.node) > 200
    for one in (fast, alone):
        assert all((getattr(one, c) == getattr(slow, c)).all() for c in ("node", "feature", "bin", "n"))
        assert np.allclose(one.value, slow.value, rtol=1e-12)


def test_large_nodes_are_read_in_parts_that_sums_can_hold(monkeypatch):
    x, y, _ = table(6000, 6, 8)
    x[:, 3:] %= 2
    whole = T.grow(x, 1.0 * (y == 0), 1.0 * (y == 1), T.TreeSpec(depth=6), 1)
    add, parts = T.Bits.sums, []

    def small(bits, rows, place, units, step, *rest):
        return big(bits, rows, place, units, 500, *rest)

    big = T._big_nodes
    monkeypatch.setattr(T, "_big_nodes", small)
    monkeypatch.setattr(T.Bits, "sums", lambda self, words, values, *r: parts.append(len(values)) or add(self, words, values, *r))
    again = T.grow(x, 1.0 * (y == 0), 1.0 * (y == 1), T.TreeSpec(depth=6), 1)
    assert max(parts) == 500 and all((getattr(whole, c) == getattr(again, c)).all() for c in ("node", "feature", "bin", "value", "n"))


def test_groups_of_a_model_are_packed_side_by_side(spark, rows, monkeypatch):
    """For scoring; in order, and as one by one."""
    import threading
    monkeypatch.setattr(E, "GROUP_ROWS", 900 * 5)
    model = E.fit(rows, features(rows), [E.Member("f", T.TreeSpec("forest", 10, 4))], F.col("row_id"))["f"]
    both, pack = threading.Barrier(2, timeout=30), T.Packed.__init__
    monkeypatch.setattr(T.Packed, "__init__", lambda self, *columns: both.wait() < 2 and pack(self, *columns))
    sent = [s.value for s in model.sent(spark)]
    monkeypatch.setattr(T.Packed, "__init__", pack)
    monkeypatch.setattr(E, "READERS", 1)
    model._sent = None
    for one, other in zip(sent, [s.value for s in model.sent(spark)], strict=True):
        assert len(one.root) == 5 and (one.step == other.step).all() and (one.value == other.value).all()


def test_search_reads_each_model_once(spark, rows, monkeypatch):
    """Both sets are scored by the models as sent the first time."""
    from pertinax.operators import models as L
    read, nodes = [], E.Ensemble.nodes
    monkeypatch.setattr(E.Ensemble, "nodes", lambda self, spark: read.append(self.prefix) or nodes(self, spark))
    specs = [L.ModelSpec("f", "forest", dict(numTrees=5, maxDepth=4)), L.ModelSpec("g", "boost", dict(maxIter=3, maxDepth=3)),
             L.ModelSpec("v", "vote", members=["f", "g"])]
    part = F.col("row_id") % 3
    board, best = L.search(specs, rows.where(part == 0), rows.where(part == 1), rows.where(part == 2), ["x1", "x2", "noise"],
                           binary=["flag"], categorical=["kind"])
    assert board.count() == 3 and best and sorted(read) == ["m0_", "m1_"]


@pytest.mark.parametrize("min_leaf,zero", [(1, False), (3, False), (1, True)])
def test_boosting_reads_the_smaller_child_only(monkeypatch, min_leaf, zero):
    """Sums left over from the parent's are those of reading every node, to the last bit; rows get their leaf's value."""
    x, y, _ = table(4000, 14, 5)
    x[:, 4:] %= 2
    q = np.random.default_rng(2).uniform(0.05, 0.95, len(y))
    g, h = q - y, q * (1 - q) * ~(zero & (np.arange(len(y)) % 7 == 0))
    spec = T.TreeSpec("boost", 1, 8, 2, min_leaf, tree_columns=0.8, l2=1.0)
    rows = np.flatnonzero(np.arange(len(y)) % 5)
    read, sums = [], T.Columns.sums
    monkeypatch.setattr(T.Columns, "sums", lambda self, rows, *a: read.append(len(rows)) or sums(self, rows, *a))
    fast, value = T.grow_boosted(T.Columns(x), rows, g[rows], h[rows], spec, 2)
    levels = len(read)
    assert levels > 5 and all(n <= len(rows) / 2 for n in read[1:])
    level = T._level
    monkeypatch.setattr(T, "_level", lambda *a: level(*a[:7], None, *a[8:]))
    slow = T.grow_boosted(T.Columns(x), rows, g[rows], h[rows], spec, 2)[0]
    monkeypatch.setattr(T, "KEEP_CELLS", 300)                      # nodes part by part
    parts = T.grow_boosted(T.Columns(x), rows, g[rows], h[rows], spec, 2)[0]
    for other in (slow, parts):
        assert len(fast.node) > 100 and all((getattr(fast, c) == getattr(other, c)).all() for c in ("node", "feature", "bin", "value", "n"))
    packed = T.Packed(np.zeros(len(fast.node), int), fast.node, fast.feature, fast.bin, fast.value)
    assert (packed.sums(x[rows]) == value).all()


def test_a_small_table_goes_to_each_task_once(spark, rows):
    """Not its drawn rows once a tree."""
    blocks, deal = [], type(rows).repartitionById
    try:
        type(rows).repartitionById = lambda self, n, c: blocks.append((self, n)) or deal(self, n, c)
        models = E.fit(rows, features(rows), [E.Member("f", T.TreeSpec("forest", 300, 4)), E.Member("b", BOOST)], F.col("row_id"))
    finally:
        type(rows).repartitionById = deal
    (dealt, tasks), = blocks
    assert tasks == 4 * spark.sparkContext.defaultParallelism + 1
    sent = dealt.select(F.sum(F.length("row") / 8).alias("n"), F.count_distinct("deal").alias("deals")).first()
    assert sent["deals"] == tasks and sent["n"] == 900 * tasks
    assert models["f"].nodes(spark).select("tree").distinct().count() == 300


def test_a_table_of_many_rows_goes_to_each_task_once(spark, monkeypatch):
    """600,000 rows need no histograms from all tasks and no drawn rows once a tree."""
    monkeypatch.setattr(E, "_upper", None)
    monkeypatch.setattr(E, "MANY_ROWS", 1)
    rows = spark.range(600_000).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("x1"),
                                       (F.col("id") % 97 > 50).cast("double").alias("label"))
    deals, deal = [], type(rows).repartitionById
    monkeypatch.setattr(type(rows), "repartitionById", lambda self, n, c: deals.append(n) or deal(self, n, c))
    trees = 3 * spark.sparkContext.defaultParallelism
    models = E.fit(rows, E.Features(["x1"]), [E.Member("f", T.TreeSpec("forest", trees, 2)),
                                              E.Member("b", T.TreeSpec("boost", 2, 2))], F.col("row_id"))
    assert deals == [2 * spark.sparkContext.defaultParallelism + 1]
    few = rows.where("row_id < 97")
    assert [m.nodes(spark).select("tree").distinct().count() for m in models.values()] == [trees, 2]
    assert all(accuracy(m, few) > 0.95 for m in models.values())


def test_a_task_keeps_the_bins_of_one_member_at_a_time():
    x, y, _ = table(500, 4, 6)
    x[::7, 1] = T.MISSING
    part = lambda s: (s, *[np.ascontiguousarray(v[s:s + 250]).tobytes() for v in (
        np.arange(500), y.astype(float), np.ones(500), np.zeros(500, np.int32), x)])
    fills = [np.full(4, k, np.uint8) for k in (3, 9, 9)]
    members = [E.Member("f", T.TreeSpec("forest", 2, 4)) for _ in fills]
    rows = E.Rows(E.Work(members, fills, [np.arange(31.0)] * 4, [0.0] * 3), [part(250), part(0)])
    for m, fill in enumerate((3, 9, 9)):
        got = rows.tree((m, m, 0))
        assert (rows.fill(m) == np.where(x == T.MISSING, fill, x)).all() and len(rows.filled) == len(rows.bits) == 1
        alone = E.Rows(E.Work(members[:1], fills[m:m + 1], [np.arange(31.0)] * 4, [0.0]), [part(0), part(250)])
        assert alone.tree((m, 0, 0)).equals(got) and alone.fill(0) is alone.x


def test_members_of_a_vote_are_those_fitted_alone(spark, rows):
    from pertinax.operators import models as L
    specs = {"a_": L.ModelSpec("f", "forest", dict(numTrees=9, maxDepth=5)), "b_": L.ModelSpec("g", "boost", dict(maxIter=5, maxDepth=3))}
    for (prefix, model), spec in zip(L.fit_members(specs, rows, ["x1", "x2", "noise"], binary=["flag"], categorical=["kind"]), specs.values()):
        alone = L.member_pipeline(spec, ["x1", "x2", "noise"], prefix=prefix, binary=["flag"], categorical=["kind"]).fit(rows)
        assert model.prefix == prefix and nodes(model, spark) == nodes(alone, spark)


def test_scores_are_those_of_a_walk():
    x, y, w = table(400, 6, 9)
    values = x * 1.5
    values[::7, 2] = np.nan
    forest = [T.grow(x, w * (y == 0), w * (y == 1), T.TreeSpec(depth=9, min_split=2, min_leaf=1), t) for t in range(4)]
    c = [np.concatenate([getattr(g, k) for g in forest]) for k in ("node", "feature", "bin", "value")]
    tree = np.repeat(np.arange(4), [len(g.node) for g in forest])
    want = []
    for row in values:
        total = 0.0
        for t, g in enumerate(forest):
            at = {int(n): k for k, n in enumerate(g.node)}
            n = 1
            while g.feature[at[n]] >= 0:
                n = 2 * n + (not row[g.feature[at[n]]] <= g.bin[at[n]] * 1.5)
            total += g.value[at[n]]
        want.append(total)
    assert T.Packed(tree, c[0], c[1], c[2] * 1.5, c[3]).sums(values, rows=64) == pytest.approx(want)


def test_packed_bytes_of_sliced_columns():
    import pyarrow as pa
    whole = pa.array([bytes([i, i + 1, i + 2]) for i in range(20)], pa.binary())
    some = pa.chunked_array([whole.slice(3, 4), whole.slice(0, 0), whole.slice(10, 2)])
    assert E._bytes(some, 3)[:, 0].tolist() == [3, 4, 5, 6, 10, 11]
    assert E._bytes(whole.slice(5, 0), 3).shape == (0, 3)
    assert E._bytes(whole.cast(pa.large_binary()).slice(5, 2), 3).tolist() == [[5, 6, 7], [6, 7, 8]]


def test_extract_of_one_file_is_prepared_and_scored_by_many_tasks(spark, tmp_path):
    from pertinax.plans.catalog_ml import training_frame
    spark.range(2000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id % 50 AS user_id", "'view' AS event_type",
                                 "id * 37 % 80 + 0.5D AS value", "'' AS props").coalesce(1).write.parquet(f"file:{tmp_path}/events.parquet")
    tasks = training_frame(spark, f"file:{tmp_path}").select("label", F.spark_partition_id().alias("t")).distinct()
    assert tasks.select("t").distinct().count() >= spark.sparkContext.defaultParallelism


def test_end_to_end_scores_each_set_once(spark, tmp_path):
    from pertinax.plans.catalog_ml import l8_train_end_to_end
    spark.range(2000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id % 50 AS user_id", "'view' AS event_type",
                                 "id * 37 % 80 + 0.5D AS value", "'' AS props").write.parquet(f"file:{tmp_path}/events.parquet")
    out = l8_train_end_to_end(spark, f"file:{tmp_path}", {"forest": dict(numTrees=4, maxDepth=3, minInstancesPerNode=2, minSamplesSplit=5)})
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()      # what is left reads scores
    assert sorted(r["set"] for r in out.where("counts_ok AND accuracy_ok AND same_after_reload").collect()) == ["reloaded_test", "test", "train"]
