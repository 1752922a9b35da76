import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M, queries

SF01 = "/root/testdata/sf0.01"


def test_totals_meet_targets(spark):
    rows = queries.op9_mixing(spark, SF01).collect()
    tokens = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert len(rows) == 1000 and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert all(r.n_tokens == len(texts[r.doc_id].split()) for r in rows)
    want = np.array([queries.MIX[d] for d in ("clean", "low", "toxic")]) * tokens.sum()
    assert np.allclose((rate * tokens) @ p, want, rtol=0.01)
    copies = np.array([r.copies for r in rows], float)
    assert (np.abs(copies - rate) < 1).all() and (np.abs((copies * tokens) @ p - want) < tokens.max()).all()  # one long document more or less


def test_copies_meet_targets_of_the_larger_table(spark):
    """The copies' totals, not only the rates', are the domains' targets."""
    rows = queries.op9_mixing(spark, "/root/testdata/sf0.1").collect()
    tokens, copies, rate = (np.array([getattr(r, c) for r in rows], float) for c in ("n_tokens", "copies", "rate"))
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows])
    want = np.array([queries.MIX[d] for d in ("clean", "low", "toxic")]) * tokens.sum()
    assert (np.abs(copies - rate) < 1).all()
    assert np.allclose((rate * tokens) @ p, want, rtol=0.01)
    print("copies over targets:", (copies * tokens) @ p / want)
    assert np.allclose((copies * tokens) @ p, want, rtol=0.02)


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(0, 500, 200)
    table = spark.createDataFrame([(int(k), [float(x) for x in q]) for k, q in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    have = n @ p
    goal = have * np.array([0.5, 1.8, 1.0])
    mix = M.fit_rates(table, ["a", "b", "c"], dict(zip("abc", goal.tolist(), strict=True)), most_steps=40)
    rates = np.array([r[0] for r in table.select(mix.rate).collect()])
    r, inverse = np.ones(200), np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(mix.steps):
        r = np.maximum(0, r - p @ (inverse @ ((r * n) @ p - goal)))
    assert np.allclose(rates, r, atol=1e-6) and (rates >= 0).all() and (rates == 0).any()
    assert np.allclose((rates * n) @ p, goal, rtol=1e-2)


def test_model_against_brute_force(spark):
    rows = [("clean", "the cat sat"), ("clean", "the dog"), ("low", "XX XX !!!"), ("toxic", "the fool sat"), (None, "no domain")]
    sample = spark.createDataFrame(rows, "domain string, text string")
    model = M.fit_domains(sample)
    assert model.domains == ["clean", "low", "toxic"] and np.allclose(np.exp(model.prior).sum(), 1, atol=0.3)
    at = spark.createDataFrame([("the fool",)], "text string").select(F.transform(M.hashes(F.col("text")), M.bucket).alias("b")).first().b
    logits = np.array([pr + sum(ra[i] for i in at) / 2.0 for pr, ra in zip(model.prior, model.ratios, strict=True)])
    want = np.exp(logits) / np.exp(logits).sum()
    got = M.memberships(spark.createDataFrame([(1, "the fool")], "doc_id long, text string"), model).first().posterior
    assert np.allclose(got, want, rtol=0.02)


def test_plan_has_no_python(spark, sf):
    plan = queries.op9_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_hard_tables(spark, tmp_path):
    spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 9000, "c"), (3, "x " * 9000, "c"), (None, "!!", "d")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op9_mixing(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r.rate for r in rows} == {1.0} and {r.copies for r in rows} == {1}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = M.DomainModel(["only"], [0.0], [[0.0] * M.BUCKETS])
    assert [round(r.rate, 6) for r in M.mixed(docs, one, {"only": 1.0}, total=9000.0).orderBy("n_tokens").collect()][-1] == pytest.approx(0.5, abs=1e-3)
    assert M.mixed(docs.limit(0), one, {"only": 1.0}).count() == 0
    clash = M.mixed(docs.withColumn("Rate", F.lit(-1)), one, {"only": 1.0}, carry=["doc_id", "Rate"])
    assert clash.columns == ["doc_id", "n_tokens", "posterior", "rate", "copies"] and {r.rate for r in clash.collect()} == {1.0}


@pytest.mark.parametrize("rate", [0.0, 0.04, 0.15, 0.95, 1.0, 1.1, 1.5, 1.85, 2.0])
def test_copies_follow_rates(spark, monkeypatch, rate):
    """Near a whole number too, the copies have the rate as mean, whatever the groups."""
    monkeypatch.setattr(M, "IN_GROUP", 500)
    table = spark.range(5_000).select((F.col("id") % 700).alias("n_tokens"), F.array(F.lit(0.4), F.lit(0.6)).alias("posterior"), F.lit(rate).alias("rate"), F.col("id").alias("drawn_by"))
    n = M.with_copies(table, 5_000).agg(F.avg("copies"), F.min("copies"), F.max("copies")).first()
    assert n[0] == pytest.approx(rate, abs=0.003) and rate - 1 < n[1] <= n[2] < rate + 1


def test_copies_meet_targets(spark):
    """Hard and soft memberships, with rates that are near whole numbers; null keys are drawn apart."""
    rng = np.random.default_rng(6)
    text = {"a": "alpha beta gamma", "b": "delta epsilon zeta", "c": "eta theta iota"}
    rows = [(None if i % 3 else i, " ".join(rng.choice(text[d].split(), rng.integers(20, 60)))) for d, n in (("a", 3000), ("b", 1000), ("c", 1000)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.fit_domains(spark.createDataFrame([(t, d) for d, t in text.items() for _ in range(100)], "text string, domain string"))
    have = {d: sum(len(t.split()) for _, t in rows if t.split()[0] in text[d].split()) for d in text}
    for rates in ({"a": 1.11, "b": 0.9, "c": 0.1}, {"a": 1.18, "b": 1.9, "c": 0.17}):
        goal = {d: r * have[d] for d, r in rates.items()}
        got = M.mixed(docs, model, goal, total=sum(goal.values())).collect()
        for i, d in enumerate(model.domains):
            assert sum(r.copies * r.n_tokens * r.posterior[i] for r in got) == pytest.approx(goal[d], rel=0.02 if rates[d] > 0.5 else 0.25)
            assert sum(r.rate * r.n_tokens * r.posterior[i] for r in got) == pytest.approx(goal[d], rel=0.01)


def test_whole_domain_and_small_share(spark):
    """Clean rows all stay, and the low ones meet their small share though they are many."""
    rows = [(i, [0.97, 0.03] if i % 7 else [0.6, 0.4], 100) if i < 2000 else (i, [0.02, 0.98], 100) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, posterior array<double>, n_tokens long")
    clean = sum(p[0] * n for _, p, n in rows)
    low = 0.15 * clean
    least = F.when(F.col("posterior")[0] > 0.5, 1.0).otherwise(0.0)
    mix = M.fit_rates(table, ["clean", "low"], {"clean": clean, "low": low}, least=least)
    got = M.with_copies(table.withColumns({"rate": mix.rate, "drawn_by": F.col("doc_id")}), len(rows)).collect()
    assert all(r.copies >= 1 for r in got if r.posterior[0] > 0.5)
    assert sum(r.copies * r.n_tokens * r.posterior[0] for r in got) == pytest.approx(clean, rel=0.02)
    assert sum(r.copies * r.n_tokens * r.posterior[1] for r in got) == pytest.approx(low, rel=0.1)


@pytest.mark.parametrize("sf,off", [("sf0.01", 0.05), ("sf0.1", 0.02)])
def test_every_domain_gets_its_tokens(spark, sf, off):
    """Copies of op9 and of the pipeline's weights, by domain, against what their rates come to."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = queries.domain_model(spark, f"/root/testdata/{sf}", docs)
    for weights, kw in ((queries.MIX, {}), ({**P.MIX, "toxic": 0.02}, {"total_of": "clean", "whole": "clean"})):
        rows = M.mixed(docs, model, weights, **kw).collect()
        tokens, copies, rate = (np.array([getattr(r, c) for r in rows], float) for c in ("n_tokens", "copies", "rate"))
        p = np.array([r.posterior for r in rows])
        want = (rate * tokens) @ p
        assert (np.abs(copies - rate) < 1).all() and np.allclose((copies * tokens) @ p, want, rtol=off), ((copies * tokens) @ p / want, weights)
