import math

import numpy as np
import pytest
import xxhash

from paperloom.llm import mixing
from tests.llm.conftest import words

TARGETS = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}


def bucket(word):
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS


def test_posteriors_against_plain_python(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = documents.where("doc_id % 2 = 0").select("doc_id", documents.lang.alias("domain"))
    prior, weights = mixing.fit_classifier(documents, labelled, list(TARGETS))
    rows = documents.collect()
    for d, domain in enumerate(TARGETS):
        own = [r for r in rows if r.doc_id % 2 == 0 and r.lang == domain]
        counts = np.ones(mixing.BUCKETS)
        for r in own:
            for w in words(r.text.lower()):
                counts[bucket(w)] += 1
        assert np.allclose(weights[d], np.log(counts / counts.sum()))
        assert prior[d] == pytest.approx(math.log((len(own) + 1) / (sum(r.doc_id % 2 == 0 for r in rows) + 4)))
    got = {r.doc_id: r for r in mixing.posteriors(documents, (prior, weights), ["doc_id"]).collect()}
    for r in rows:
        w = words(r.text.lower())
        s = np.array([p + min(1, mixing.EVIDENCE_WORDS / max(len(w), 1)) * sum(t[bucket(x)] for x in w) for p, t in zip(prior, weights)])
        p = np.exp(s - s.max())
        assert got[r.doc_id].n_tokens == len(w) and np.allclose(got[r.doc_id].posterior, p / p.sum(), atol=1e-9)


def test_totals_match_targets(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = documents.select("doc_id", documents.lang.alias("domain"))
    got = mixing.mixing_rates(documents, labelled, TARGETS).toPandas()
    totals = (np.stack(got["posterior"]) * (got["rate"] * got["n_tokens"]).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(totals / totals.sum(), list(TARGETS.values()), atol=2 * mixing.TOLERANCE)
    assert got["rate"].min() >= 1 and (got["copies"] >= np.floor(got["rate"])).all()
    less = mixing.mixing_rates(documents, labelled, TARGETS, total_tokens=1000.0).toPandas()
    totals = (np.stack(less["posterior"]) * (less["rate"] * less["n_tokens"]).to_numpy()[:, None]).sum(axis=0)
    assert totals.sum() == pytest.approx(1000, rel=1e-4) and less["rate"].min() >= 0


def problem(seed, n=80, k=4, concentration=0.15):
    r = np.random.default_rng(seed)
    share = np.maximum(r.dirichlet([1.0] * k), 0.05)
    return r.dirichlet([concentration] * k, n), r.integers(1, 400, n), share / share.sum()


def as_table(spark, q, n):
    return spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(n, q)], "n_tokens long, posterior array<double>").coalesce(1)


@pytest.mark.parametrize("seed, total", [(0, None), (1, None), (2, 1.0)])
def test_random_problems_meet_their_targets_with_the_bound_at_work(spark, seed, total):
    """Sharp posteriors and uneven targets clip many rates; the targets are still met, for the whole number of tokens and for the least."""
    q, n, share = problem(seed)
    whole = None if total is None else float(total * n.sum())
    rated, fit = mixing.fit_rates(as_table(spark, q, n), share.tolist(), whole, 1.0 if total is None else 0.0)
    rows = rated.collect()
    reached = sum(np.array(r.posterior) * r.n_tokens * r.rate for r in rows)
    least = min(r.rate for r in rows)
    assert fit.residual <= mixing.TOLERANCE and np.allclose(reached, fit.reached)
    assert np.allclose(reached / reached.sum(), share, atol=2 * mixing.TOLERANCE)
    assert least >= (1 if total is None else 0) and sum(r.rate == least for r in rows) > 1
    if total is not None:
        assert reached.sum() == pytest.approx(whole, rel=1e-4)


def test_unreachable_targets_are_reported(spark):
    """All documents belong to both domains alike, so no rates give one domain more."""
    table = as_table(spark, np.full((20, 2), 0.5), np.full(20, 10))
    with pytest.warns(UserWarning, match="missed by 0.2"):
        _, fit = mixing.fit_rates(table, [0.7, 0.3], 400.0, 0.0, max_steps=6)
    assert fit.residual == pytest.approx(0.2, abs=0.01) and not fit.met
    with pytest.warns(UserWarning, match="missed by"):
        rated, fit = mixing.fit_rates(table, [0.7, 0.3], max_steps=12)
    assert not fit.met and {r.rate for r in rated.collect()} == {1.0}


def test_domains_without_tokens_are_left_out(spark):
    table = as_table(spark, np.array([[0.8, 0.2, 0.0], [0.3, 0.7, 0.0]]), np.array([10, 10]))
    _, fit = mixing.fit_rates(table, [0.5, 0.3, 0.2])
    assert fit.targets[2] == 0 and fit.reached[0] / fit.reached[1] == pytest.approx(5 / 3, rel=1e-3)


def test_kinds_of_unlabelled_documents_are_predicted(spark, sf_dir):
    """Fitted on the labels of even ids, posteriors of odd ids tell clean documents and junk apart; accuracy as measured, with some room."""
    from paperloom.llm import queries

    folder = sf_dir.replace("sf0.001", "sf0.1")
    documents, kinds = spark.read.parquet(f"{folder}/documents.parquet"), queries.labelled_kinds(spark, folder)
    domains = list(queries.KIND_TARGETS)
    model = mixing.fit_classifier(documents, kinds.where("doc_id % 2 = 0"), domains)
    got = mixing.posteriors(documents, model, ["doc_id"]).join(kinds.where("doc_id % 2 = 1"), "doc_id").collect()
    right = {d: np.mean([domains[int(np.argmax(r.posterior))] == d for r in got if r.domain == d]) for d in domains}
    assert right["clean"] >= 0.97 and right["junk"] >= 0.65
    toxic = [np.mean([r.posterior[1] for r in got if r.domain == d]) for d in ("toxic", "clean")]
    assert toxic[0] > 1.5 * toxic[1]


def test_edge_rows(spark, edge, edge_rows, empty):
    labelled = spark.createDataFrame([(0, "en"), (1, "en"), (13, "fr"), (None, "de"), (9, "xx")], "doc_id long, domain string")
    out = mixing.mixed_documents(edge, labelled, TARGETS)
    assert out.columns == edge.columns
    got = [tuple(r)[:2] for r in out.collect()]
    assert {r[:2] for r in map(tuple, edge_rows)} <= set(got) and len(got) >= len(edge_rows)
    rates = mixing.mixing_rates(edge, labelled, TARGETS).collect()
    assert len(rates) == len(edge_rows) and all(r.posterior[2] == r.posterior[3] == 0 for r in rates)  # no labelled rows of these
    assert mixing.mixing_rates(empty, labelled, TARGETS).count() == 0
    unlabelled = mixing.mixing_rates(edge, labelled.where("false"), {"en": 0.5, "fr": 0.5}).collect()
    assert {r.rate for r in unlabelled} == {1.0} and {tuple(r.posterior) for r in unlabelled} == {(0.5, 0.5)}


def test_main_path_is_native(spark, edge):
    labelled = spark.createDataFrame([(0, "en"), (1, "fr")], "doc_id long, domain string")
    plan = mixing.mixed_documents(edge, labelled, TARGETS)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_few_passes_read_the_documents(spark, sf_dir):
    """Rehearsed on cells, the fit ends after a few steps over the documents, and says how."""
    documents = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    mixed, fit = mixing.mixed_with_fit(documents, documents.where("doc_id % 2 = 0").select("doc_id", documents.lang.alias("domain")), TARGETS)
    assert fit.met and fit.steps <= 12 and mixed.count() >= documents.count()
    assert sum(fit.reached) == pytest.approx(sum(fit.targets), rel=1e-4)
