"""Factorization, geometry, influence, feeds and monitors: both forms, closed forms, and defined edge cases."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.config import Knobs, Settings
from brindle.plans import model_queries, rater_queries, registry
from brindle.plans.window import Engine
from brindle.operators import blocks, core, economy, factorization, feed, geometry, metrics, monitor, propensity, rater, reception, simulate
from brindle.session import listed
from tests.conftest import DATA

S = Settings(d=2, mf_iterations=2, mf_tolerance=-1.0)


@pytest.fixture(scope="module")
def world(spark):
    """Two camps of five users; A pleases both, B and C one each."""
    rows = [(f"u{u}", p, f"auth{p}", 1.0 if p == "A" or (p == "B") == (u < 5) else -1.0, float(u + 1)) for u in range(10) for p in "ABC"]
    return spark.createDataFrame(rows, "user_id string, post_id string, author_id string, value double, weight double").cache()


def test_both_forms_of_the_factorization_agree(world):
    a, b = (factorization.fit(world, S, local_rows=n) for n in (0, 1000))
    assert a.sweeps == b.sweeps == 2 and abs(a.mu - b.mu) < 1e-9 and abs(a.rmse - b.rmse) < 1e-9
    x, y = ({r["post_id"]: (r["b_p"], *r["y"]) for r in m.posts.collect()} for m in (a, b))
    assert x.keys() == y.keys() and all(np.allclose(x[k], y[k]) for k in x)


def test_factorization_is_the_same_in_any_order(world):
    a, b = factorization.fit(world, S), factorization.fit(world.repartition(7, "value").orderBy(F.desc("user_id")), S)
    assert abs(a.rmse - b.rmse) < 1e-12


def test_factorization_errors(world):
    with pytest.raises(ValueError):
        factorization.fit(world.limit(0), S)
    with pytest.raises(ValueError):
        factorization.fit(world.withColumn("weight", F.lit(-1.0)), S)


def test_spectral_clusters_find_the_camps(world):
    got = {r["user_id"]: r["cluster"] for r in geometry.spectral_partition(world, 2).collect()}
    assert len({got[f"u{u}"] for u in range(5)}) == 1 and got["u0"] != got["u9"]


def test_both_forms_of_the_coordinates_agree(world):
    cells = geometry.centred_cells(world)
    (a, va), (b, vb) = (geometry.singular_coordinates(cells, 1, extra=1, rounds=6, local_rows=n) for n in (0, 1000))
    assert np.allclose(va, vb)
    x, y = ({r["user_id"]: r["c0"] for r in t.collect()} for t in (a, b))
    assert all(abs(abs(x[k]) - abs(y[k])) < 1e-6 for k in x)


def test_both_forms_of_the_means_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.normal(0, 1, (40, 2)) + 4 * rng.integers(0, 3, (40, 1)), 1))]
    points = spark.createDataFrame(rows, "user_id string, c0 double, c1 double")
    a, b = ({r["user_id"]: r["cluster"] for r in geometry.lloyd(points, 2, 3, local_rows=n).collect()} for n in (0, 100))
    assert a == b and len(set(a.values())) == 3


def test_degenerate_partitions(spark, world):
    assert {r["cluster"] for r in geometry.spectral_partition(world, 1).collect()} == {0}
    few = geometry.spectral_partition(world.filter("user_id < 'u2'"), 3).orderBy("user_id").collect()
    assert [(r["user_id"], r["cluster"]) for r in few] == [("u0", 0), ("u1", 1)]


def test_both_forms_of_trust_agree(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (60, 2)) if a != b})
    edges = spark.createDataFrame(pd.DataFrame([(a, b, 1.0) for a, b in rows], columns=["src", "dst", "t"]))
    edges = edges.withColumn("t", F.col("t") / F.count(F.lit(1)).over(core.Window.partitionBy("src")))
    users = spark.createDataFrame([(f"n{i}",) for i in range(12)], "user_id string")
    a, b = ({r["user_id"]: r["lambda"] for r in rater.eigentrust(users, edges, S, iterations=6, local_rows=n).collect()} for n in (0, 1000))
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a) and abs(sum(a.values()) - 1) < 1e-9


def test_ring_is_muted_by_diversity(spark):
    users = spark.createDataFrame([(f"n{i}",) for i in range(8)], "user_id string")
    honest = spark.createDataFrame([(f"n{i}", f"n{j}", 1 / 3) for i in range(8) for j in ((i + 1) % 8, (i + 2) % 8, (i + 3) % 8)], "src string, dst string, t double")
    puppets = spark.range(30).select(F.concat(F.lit("z"), "id").alias("user_id"))
    edges, everyone = rater.ring(honest, puppets, "n0"), users.unionByName(puppets)
    open_ = rater.percentile_of(rater.eigentrust(everyone, edges, S), "n0").first()[0]
    weights = rater.eigentrust(everyone, edges, S, transmit=rater.out_diversity(edges))
    by = {r["user_id"]: r["lambda"] for r in weights.collect()}
    assert open_ > 90 and by["n0"] < 1.5 * by["n4"]


def test_scouts_beyond_the_head_of_a_hot_post_stand_at_zero(spark):
    rows = [(i, f"u{i}", "hot", 1.0, float(i)) for i in range(1600)] + [(2000, "u1599", "cold", 1.0, 0.0), (2001, "no", "hot", -1.0, 0.0)]
    reactions = spark.createDataFrame(rows, "ordinal long, user_id string, post_id string, value double, ts double")
    strength = spark.createDataFrame([("hot", 0.5), ("cold", 0.25)], "post_id string, strength double")
    # at this alpha 8 approvals of each of the 64 slices are ranked again
    got = {r["user_id"]: r["scout"] for r in rater.scout_precision(reactions, strength, 100.0).collect()}
    assert len(got) == 1600 and got["u0"] == 0.5 and got["u1598"] == 0.0 and got["u1599"] == 0.25


def test_shrinkage_to_the_global_mean(spark):
    rec = spark.createDataFrame([("B", 0, 40.0, 0.9), ("B", 1, 40.0, -0.6)], "post_id string, cluster int, n_cp double, r_emp double")
    posts = spark.createDataFrame([("B",), ("new",)], "post_id string")
    got = {r["post_id"]: r["b_lcb"] for r in reception.score_posts(posts, rec, 0.1, Settings(aggregator="min")).collect()}
    assert abs(got["B"] - (0.1 + 40 / 48 * (-0.6 - 0.1))) < 1e-12 and abs(got["new"] - 0.1) < 1e-12
    with pytest.raises(ValueError):
        reception.aggregate(F.lit(0), "mean")


def test_budgets(spark):
    posts = spark.createDataFrame([("p", "a"), ("q", "a"), ("r", "b")], "post_id string, identity_id string")
    strength = spark.createDataFrame([("p", 1.0), ("q", -1.0), ("r", 0.5)], "post_id string, strength double")
    exposure = spark.createDataFrame([("p", 2.0), ("q", 9.0), ("r", 400.0)], "post_id string, exposure double")
    earned = economy.earned(posts, strength, exposure)
    got = {r["identity_id"]: r["budget"] for r in economy.replenish(earned, None).collect()}
    assert got == {"a": 12.0, "b": 100.0}
    share = {r["identity_id"]: r["budget"] for r in economy.replenish(earned, None, Settings(budget_share=True)).collect()}
    assert abs(sum(share.values()) - 40.0) < 1e-9


def test_controller_tightens_and_relaxes():
    c = monitor.Controller(Settings())
    assert c.step(0.9).delta == pytest.approx(0.83) and c.state.epsilon_min == pytest.approx(0.06)
    assert c.step(0.1).delta == pytest.approx(0.84) and c.state.epsilon_min == pytest.approx(0.055)
    quiet = monitor.Controller(Settings(cusum=True))
    assert [quiet.step(g).alarm for g in [0.2, 0.21, 0.2, 0.19, 0.2, 0.2]] == [False] * 6
    assert any(quiet.step(0.35).alarm for _ in range(30))


def test_whiteness_flags_a_hidden_camp(spark):
    rng = np.random.default_rng(3)
    users = [f"u{i}" for i in range(24)]
    camp = [i % 2 for i in range(24)]
    rows = [(u, f"p{k}", (1.0 if camp[i] == k % 2 else -1.0) * float(rng.uniform(0.8, 1.2))) for i, u in enumerate(users) for k in range(8)]
    reactions = spark.createDataFrame(rows, "user_id string, post_id string, value double")
    residuals = [("hidden", u, 1.0 if camp[i] else -1.0) for i, u in enumerate(users)] + [("white", u, float(rng.normal())) for u in users] + [("few", "u0", 1.0)]
    got = monitor.residual_whiteness(spark.createDataFrame(residuals, "post_id string, user_id string, value double"), monitor.coreaction_edges(reactions, reactions.select("user_id").distinct()))
    by = {r["post_id"]: r for r in got.collect()}
    assert by["hidden"]["p_value"] < 0.05 and by["hidden"]["morans_i"] > 0.5 and by["white"]["p_value"] > 0.02 and by["few"]["p_value"] == 1.0


@pytest.mark.parametrize("size", [7, 1000])
def test_morans_i_by_blocks_is_that_of_the_edges(spark, size):
    rng = np.random.default_rng(6)
    rows = sorted({(f"u{u}", f"p{min(p, 6 + u % 9)}"): float(np.round(v, 1)) for u, p, v in zip(rng.integers(0, 40, 300), rng.geometric(0.2, 300), rng.normal(size=300))}.items())
    reactions = spark.createDataFrame([(u, p, v) for (u, p), v in rows], "user_id string, post_id string, value double")
    values = reactions.select("user_id").distinct().withColumn("value", (F.ascii(F.substring("user_id", -1, 1)) % 7).cast("double"))
    edges = monitor.coreaction_edges(reactions, reactions.select("user_id").distinct()).cache()
    got = monitor.morans_i_by_blocks(reactions, values, size).first()
    assert got["edges"] == edges.filter("w > 1e-9").count() > 0 and abs(got["morans_i"] - monitor.morans_i(values, edges).first()[0]) < 1e-9


@pytest.mark.parametrize("pairs, tile", [(40, 7), (4_000_000, 200_000)])
def test_edges_are_made_without_a_shuffle_of_pairs(spark, pairs, tile):
    rng = np.random.default_rng(8)
    cells = {(f"u{u}", f"p{p}"): float(np.round(v, 1)) for u, p, v in zip(rng.integers(0, 25, 150), rng.geometric(0.2, 150), rng.normal(size=150))}
    reactions = spark.createDataFrame([(u, p, v) for (u, p), v in cells.items()], "user_id string, post_id string, value double")
    wanted = sorted({u for u, _ in cells} - {"u3"})
    got = monitor.coreaction_edges(reactions, spark.createDataFrame([(u,) for u in wanted], "user_id string"), pairs, tile)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [u#" not in plan and "RepartitionByExpression [block" in plan
    posts = sorted({p for _, p in cells})
    vector = {u: np.array([cells.get((u, p), 0.0) for p in posts]) for u in wanted}
    vector = {u: x - x.mean() for u, x in vector.items()}
    cosine = {(u, v): vector[u] @ vector[v] / np.linalg.norm(vector[u]) / np.linalg.norm(vector[v]) for u in wanted for v in wanted if u != v and any((u, p) in cells and (v, p) in cells for p in posts)}
    want = {k: w for k, w in cosine.items() if w > 1e-12}
    rows = {(r["u"], r["v"]): r["w"] for r in got.filter("w > 1e-12").collect()}
    assert rows.keys() == want.keys() and len(want) > 50 and max(abs(rows[k] - want[k]) for k in want) < 1e-12 and got.filter("w > 1e-12").count() == len(want)


def test_morans_i_writes_no_edges(spark, monkeypatch):
    b = rater_queries.Raters(spark, DATA)
    users = b.vouches.select("user_id").distinct()
    values = users.select("user_id", (F.ascii(F.substring("user_id", -1, 1)) % 7 - 3).cast("double").alias("value"))
    want = monitor.morans_i(values, monitor.coreaction_edges(b.vouches, users)).first()[0]
    monkeypatch.delattr(monitor, "coreaction_edges")
    assert abs(registry.queries()["morans_i"](spark, DATA).first()[0] - want) < 1e-6 and want != 0


def test_hot_posts_of_a_pair_of_blocks_count_as_the_others():
    rng = np.random.default_rng(2)
    block = monitor._pack(pd.DataFrame({"block": 0, "user_id": [f"u{i % 30}" for i in range(90)], "p": [i // 30 for i in range(90)], "v": rng.normal(size=90), "m": 0.1, "z": 1.0}))["payload"][0]
    a, b = (monitor._pair_sums(block, block, True, tile=8, hot=h) for h in (0, 1_000_000))
    assert a[2] == b[2] > 0 and np.allclose(a, b)


def candidates(spark, seed: int):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(6):
        for k in range(40):
            explores = bool(rng.random() < 0.2)
            rows.append((f"u{u}", k, f"p{k}", f"a{rng.integers(0, 8)}", float(np.round(rng.normal(), 2)), float(rng.random()) if explores else 0.0, 1.0, None if explores else [float(x) for x in rng.random(2)], 1.0, explores, 2.0))
    return spark.createDataFrame(rows, "user_id string, pos int, post_id string, author_id string, base double, exploration double, posdisc double, coverage array<double>, cost double, is_exploration boolean, budget double")


def test_pruning_changes_no_feed(spark):
    rows = candidates(spark, 5).cache()
    pruned = feed.prune(rows, 6, 0.3)
    assert pruned.count() < rows.count()
    want = feed._feeds(rows.toPandas().sort_values(["user_id", "pos"]), 6, 0.3, 1.0)
    got = feed.greedy_feeds(rows, 6, 0.3).toPandas().sort_values(["user_id", "slot"])
    assert list(map(tuple, want[["user_id", "slot", "post_id"]].to_numpy())) == list(map(tuple, got[["user_id", "slot", "post_id"]].to_numpy()))
    per_author = got.merge(rows.toPandas()[["user_id", "post_id", "author_id"]]).groupby(["user_id", "author_id"]).size()
    assert per_author.max() <= 2 and got.groupby("user_id")["is_exploration"].sum().min() >= 2


def test_interleaving(spark):
    organic = spark.createDataFrame([("u", i, f"o{i}") for i in range(6)], "user_id string, slot int, post_id string")
    explore = spark.createDataFrame([("u", i, f"e{i}") for i in range(2)], "user_id string, slot int, post_id string")
    got = [r["post_id"] for r in feed.interleave(organic, explore, 8).orderBy("slot").collect()]
    assert got == ["o0", "o1", "e0", "o2", "o3", "e1", "o4", "o5"]


def test_knobs():
    with pytest.raises(ValueError):
        Knobs(M=2.0).validate()
    assert Knobs(theta={}).normalised_theta() == {"bridge": 1.0}
    assert Knobs(theta={"a": 1.0, "b": 3.0}).normalised_theta()["b"] == 0.75
    with pytest.raises(ValueError):
        replace(Settings(), aggregator="sum").validate()


def test_propensity_models(spark):
    rows = spark.createDataFrame([(0.3, 0), (None, None), (0.001, 50)], "propensity double, slot int")
    assert [r[0] for r in rows.select(propensity.logged(0.05)).collect()] == [0.3, 0.05, 0.05]
    assert [round(r[0], 6) for r in rows.select(propensity.position_based(0.05)).collect()] == [1.0, 1.0, 0.05]
    with pytest.raises(ValueError):
        propensity.uniform(0.0)


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 1)], "a double, b double, l int")
    assert metrics.spearman(rows, "a", "b").first()[0] == 0.0 and metrics.auc(rows, "a", "l").first()[0] == 0.5
    assert metrics.embedding_recovery(spark.createDataFrame([("u", [1.0], [1.0])], "user_id string, est array<double>, true array<double>")).first()[0] is None
    ranks = metrics.average_ranks(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "v double"), "v", "r")
    assert sorted((r["v"], r["r"]) for r in ranks.collect()) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5)]


def test_sweeps_leave_nothing_behind_and_crowds_change_nothing(spark, world, monkeypatch):
    kept, real = [], factorization.cut

    def cut(df):
        out = real(df)
        kept.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        return out

    monkeypatch.setattr(factorization, "cut", cut)
    left = []
    for sweeps in (1, 3):
        kept.clear()
        m = factorization.fit(world, S, sweeps=sweeps)
        left.append(sum(bool(listed(spark, k)) for k in kept))
    assert left[0] == left[1]  # not the tables of each sweep
    monkeypatch.setattr(factorization, "CROWD", 1)
    n = factorization.fit(world, S, sweeps=3)
    a, b = ({r["post_id"]: (r["b_p"], *r["y"]) for r in x.posts.collect()} for x in (m, n))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a) and abs(m.rmse - n.rmse) < 1e-9


def test_a_sweep_is_one_table(world, monkeypatch):
    made = []
    for module in (factorization, blocks):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: made.append(df) or real(df))
    counts = []
    for sweeps in (1, 3):
        made.clear()
        factorization.fit(world, S, sweeps=sweeps)
        counts.append(len(made))
    assert counts[1] - counts[0] == 2


def test_many_blocks_with_hot_posts_fit_as_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(1)
    ids = zip(rng.integers(0, 60, 900), np.minimum(rng.geometric(0.04, 900), 50))
    rows = [(f"u{u}", f"p{p}", f"a{p % 11}", float(rng.choice([1.0, 0.5, -1.0])), float(rng.random())) for u, p in ids]
    rows = spark.createDataFrame(rows, "user_id string, post_id string, author_id string, value double, weight double")
    s = replace(S, d=3)
    monkeypatch.setattr(blocks, "ROWS", 200)
    monkeypatch.setattr(blocks, "HOT", 4)
    monkeypatch.setattr(factorization, "_vectors", None)  # never joined row by row
    a, b = (factorization.fit(rows, s, local_rows=n) for n in (1000, 0))
    assert abs(a.mu - b.mu) < 1e-12 and abs(a.rmse - b.rmse) < 1e-12
    for name, bias, vector in (("users", "b_u", "x"), ("posts", "b_p", "y"), ("authors", "b_a", None)):
        x, y = ({r[0]: (r[bias], *(r[vector] if vector else ())) for r in getattr(m, name).collect()} for m in (a, b))
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-9) for k in x)


def test_kernels_in_memory_fetch_no_row_objects(spark, world, monkeypatch):
    monkeypatch.setattr(type(world), "toPandas", None)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        assert factorization.fit(world, S, local_rows=1000).sweeps == 2
        assert geometry.spectral_partition(world, 2, local_rows=1000).count() == 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def test_windows_beyond_the_bound_fetch_none_of_their_tables(spark, world, monkeypatch):
    for module in (geometry, rater):
        monkeypatch.setattr(module, "fetched", None)

    def fit(*a, local_rows):
        raise InterruptedError(local_rows)

    monkeypatch.setattr(factorization, "fit", fit)
    rows = world.select((F.row_number().over(core.Window.orderBy("user_id", "post_id"))).cast("long").alias("ordinal"), "user_id", "post_id", "value", F.lit("boost").alias("kind"), F.lit(0.0).alias("ts"))
    posts = world.select("post_id", "author_id").distinct()
    shown = rows.select("ordinal", "user_id", "post_id", F.lit(0.0).alias("timestamp"), F.lit(1).alias("slot"), F.lit("organic").alias("source"), F.lit(0.5).alias("propensity"))
    with pytest.raises(InterruptedError, match="^0$"):
        Engine(replace(S, local_rows=29)).fit_window(rows, posts, shown)  # 30 rows of 10 users
    users = spark.range(40).select(F.concat(F.lit("u"), "id").alias("user_id"))
    edges = spark.createDataFrame([("u1", "u2", 1.0)], "src string, dst string, t double")
    assert rater.eigentrust(users, edges, S, iterations=1, local_rows=20).count() == 40


def test_singular_systems_get_the_least_norm_solution():
    v = np.array([[1.0, 2.0, 0.5], [2.0, 4.0, 1.0]])
    x, explained = blocks._solved(blocks._equations(np.array([0]), v, np.ones(3), 2.0 * v[0], False), 2, 0.0)
    assert np.allclose(x[:, 0], [0.4, 0.8]) and np.allclose(explained, 4 * (v[0] ** 2).sum())


@pytest.mark.parametrize("many", [0, 1])
def test_balanced_auc_deals_out_no_draws(spark, monkeypatch, many):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.random() < 0.2) ^ many, float(np.round(rng.normal(), 1))) for k in range(600)]
    draws = []
    for draw in range(25):
        by = {c: sorted((hashlib.md5(f"{k}|{draw}|0".encode()).hexdigest(), k, x) for k, l, x in rows if l == c) for c in (0, 1)}
        n = min(map(len, by.values()))
        neg, pos = (np.array([x for *_, x in by[c][:n]]) for c in (0, 1))
        draws.append(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    met, real = [], metrics.cumulated
    monkeypatch.setattr(metrics, "cumulated", lambda pairs: met.append(pairs.count()) or real(pairs))
    table = spark.createDataFrame(rows, "k int, l int, s double")
    assert abs(metrics.balanced_auc(table, "s", "l", "k").first()[0] - np.mean(draws)) < 2e-9
    assert sum(met) < 2 * len(rows)  # not 25 times
    assert metrics.balanced_auc(table.filter("l = 1"), "s", "l", "k").first()[0] == 0.5
    # of rows that share a key as many are taken as the smaller class has
    same = spark.createDataFrame([(1, 0, 0.0), (1, 0, 0.0), (1, 0, 0.0), (2, 1, 1.0)], "k int, l int, s double")
    assert metrics.balanced_auc(same, "s", "l", "k").first()[0] == 1.0


def test_polarity_is_that_of_the_filled_matrix(spark):
    rng = np.random.default_rng(7)
    m = np.where(rng.random((12, 9)) < 0.6, np.outer(np.sign(np.arange(12) - 5.5), rng.choice([-1, 1], 9)) + 0.3 * rng.normal(size=(12, 9)), np.nan)
    rows = [(f"u{i:02d}", f"p{j}", float(m[i, j])) for i in range(12) for j in range(9) if not np.isnan(m[i, j])]
    got = {r["user_id"]: r["polarity"] for r in simulate.polarity_axis(spark.createDataFrame(rows, "user_id string, post_id string, value double")).collect()}
    full = np.where(np.isnan(m), np.nanmean(m, 0), m)
    full = full - full.mean(0) - full.mean(1, keepdims=True) + full.mean()
    want = np.linalg.svd(full)[0][:, 0]
    assert abs(abs(want @ np.array([got[f"u{i:02d}"] for i in range(12)])) - 1) < 1e-6


def test_an_anchor_makes_a_biased_log_identifiable(spark):
    # the effect of the correction is one of the mean over worlds
    runs = [{r["corrected"]: r["ranking"] for r in simulate.mnar_experiment(spark, 80, 40, 0.15, 50, seed).collect()} for seed in range(3)]
    plain, corrected = (np.mean([r[k] for r in runs]) for k in (False, True))
    starved = {r["corrected"]: r["ranking"] for r in simulate.mnar_experiment(spark, 80, 40, 0.001, 50, 0).collect()}
    assert corrected > plain and corrected > starved[True] + 0.3 and starved[True] < 0.2


def test_authors_keep_a_style_only_if_reach_did_not_fall():
    a, rng = simulate.cast(1)[0], np.random.default_rng(0)
    a.trial(0.5, rng)
    first = a.style.copy()
    a.judge(3.0)
    a.trial(0.5, rng)
    a.judge(2.0)
    assert np.allclose(a.style, first) and a.volume() == 2 and [x.volume() for x in simulate.cast(4)] == [2, 2, 2, 6]


def test_toxic_posts_draw_reactions_and_quality_draws_vouches(spark):
    people = simulate.population(spark, 60)
    posts = simulate.posts_of(simulate.authors(spark), 0)
    shown = people.crossJoin(posts).cache()
    pull = {r["author_id"]: r["p"] for r in shown.withColumn("p", simulate.reaction_pull()).groupBy("author_id").agg(F.avg("p").alias("p")).collect()}
    assert max(pull, key=pull.get) == "a4"
    merit = {r["author_id"]: r["v"] for r in simulate.vouch(shown).join(posts, "post_id").groupBy("author_id").agg(F.avg("value").alias("v")).collect()}
    assert merit["a0"] > 0.5 and merit["a5"] < -0.5
    worth = {r["author_id"]: r for r in simulate.welfare(shown).join(posts.select("post_id", "author_id"), "post_id").groupBy("author_id").agg(F.avg("true_value").alias("true_value"), F.avg("divisiveness").alias("divisiveness")).collect()}
    assert worth["a0"]["true_value"] > worth["a5"]["true_value"] > worth["a4"]["true_value"] * 0.1 and worth["a4"]["divisiveness"] > worth["a1"]["divisiveness"] * 0.9


def test_simulated_loop(spark):
    w = simulate.World(users=12, windows=2, slots=3)
    chrono, oracle = (simulate.run(spark, r, w) for r in (simulate.ChronologicalRanker(3), simulate.OracleRanker(3)))
    assert oracle.tail("true_value") > chrono.tail("true_value") and chrono.windows[1]["churn"] is not None


def test_engine_in_the_loop_with_a_ring(spark):
    s = Settings(d=1, mf_iterations=2, trust_iterations=5, out_of_band_weight=0.2, budget_base=6.0)
    w = simulate.World(users=10, authors=4, windows=2, slots=3, ring=4, camouflage=2, forged_vouches=True)
    got = simulate.run(spark, simulate.BridgingRanker(Engine(s), 3), w)
    assert [x["impressions"] > 20 for x in got.windows] == [True, True] and got.windows[1]["target_reach"] is not None


def test_served_candidates_take_stamps_of_any_unit(spark, tmp_path):
    t = 1_731_196_769.0
    rows = [("s", t - 60), ("ms", (t - 30) * 1e3), ("us", t * 1e6), ("ns", (t - 90) * 1e9), ("old", (t - 21_601) * 1e3), ("none", 0.0), ("nan", float("nan"))]
    spark.createDataFrame([(p, "a", at, None) for p, at in rows], "post_id string, author_id string, created_at double, features map<string,double>").write.parquet(str(tmp_path / "posts.parquet"))
    got = [(r["post_id"], r["created_at"]) for r in registry.queries()["served_candidates"](spark, str(tmp_path)).collect()]
    assert got == [("us", t), ("ms", t - 30), ("s", t - 60), ("ns", t - 90)]


def test_registered_fits_are_of_the_full_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(model_queries, "Engine", lambda s: asked.append(s) or Engine(s))
    monkeypatch.setattr(Engine, "fit_window", lambda self, *a: type("F", (), {"scores": spark.createDataFrame([("p", "a", 0.0)], "post_id string, author_id string, b_lcb double")}))
    monkeypatch.setattr(factorization, "fit", lambda rows, s, **kw: asked.append((s, kw)) or type("M", (), {"posts": spark.createDataFrame([("p", 0.0, [0.0])], "post_id string, b_p double, y array<double>")}))
    monkeypatch.setattr(metrics, "balanced_auc", lambda *a, **kw: asked.append((a[1:], kw)))
    for f in (model_queries.fitted_window, model_queries.mf_als_d, model_queries.balanced_auc):
        f(spark, DATA)
    assert asked == [Settings(), (Settings(), {}), (("score", "label", "ordinal"), {})]


def test_portfolio_floor():
    p = economy.RandomizationPortfolio(["a", "b"])
    p.observe("a", 5.0)
    got = p.allocate()
    assert got["a"] > got["b"] >= 0.1 and abs(sum(got.values()) - 1) < 1e-12
