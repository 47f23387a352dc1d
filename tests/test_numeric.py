import math
import statistics

import numpy as np
import pytest

from tabweave.functions import latent, linalg, special
from tabweave.functions.rng import uniform_block
from tabweave.operators import conditional, mvdist, synthesizer


def test_normal_functions_against_the_standard_library(spark):
    from pyspark.sql import functions as F

    N = statistics.NormalDist()
    p = [1e-12, 1e-6, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    assert np.allclose(special.norm_ppf(p), [N.inv_cdf(x) for x in p], rtol=1e-12)
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", special.phi_inverse(F.col("p")).alias("z"), special.phi(special.phi_inverse(F.col("p"))).alias("q")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(N.inv_cdf(r["p"]), rel=1e-12) and r["q"] == pytest.approx(r["p"], rel=1e-9)


def test_other_distributions():
    assert special.t_ppf(0.975, 5) == pytest.approx(2.570581835636314)
    assert special.gamma_ppf(0.5, 2.0) == pytest.approx(1.6783469900166605)
    assert special.t_cdf(special.t_ppf(np.linspace(0.01, 0.99, 30), 3), 3) == pytest.approx(np.linspace(0.01, 0.99, 30), abs=1e-9)
    u = np.random.default_rng(0).random(20_000)
    assert np.abs(special.gamma_cdf(special.gamma_ppf(u, 1.7), 1.7) - u).max() < 1e-5
    assert special.pois_ppf([0.1, 0.5, 0.9], 3.0).tolist() == [1, 3, 5]


def test_bivariate_normal_and_latent_correlations():
    assert latent.bivariate_normal_cdf(0, 0, 0.5) == pytest.approx(0.25 + math.asin(0.5) / (2 * math.pi))
    z = np.random.default_rng(1).multivariate_normal([0, 0], [[1, 0.7], [0.7, 1]], 20_000)
    a, b = (z[:, 0] > 0.5).astype(int), (z[:, 1] > -0.3).astype(int)
    T = np.zeros((2, 2))
    np.add.at(T, (a, b), 1)
    assert latent.polychoric(T, latent.thresholds(T.sum(1) / 20_000), latent.thresholds(T.sum(0) / 20_000)) == pytest.approx(0.7, abs=0.04)
    tau = latent.kendall_correlations(z[:300])
    brute = np.mean([np.sign((z[i, 0] - z[j, 0]) * (z[i, 1] - z[j, 1])) for i in range(300) for j in range(300) if i != j])
    assert tau[0, 1] == pytest.approx(brute)


def test_correlation_completion_and_repair():
    R = np.array([[1, np.nan, 0.5], [np.nan, 1, 0.4], [0.5, 0.4, 1]])
    W, how = linalg.complete_correlation(np.nan_to_num(R), np.isnan(R))
    assert W[0, 1] == pytest.approx(0.2) and how == "max_determinant"
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    assert np.linalg.eigvalsh(linalg.make_pd(bad)).min() > 0
    with pytest.raises(ValueError):
        linalg.make_pd(bad, "none")


def test_largest_remainder_and_closeness():
    assert synthesizer.largest_remainder(10, np.array([0.55, 0.3, 0.15])).tolist() == [6, 3, 1]
    p = synthesizer.Perturbation.closeness(0.4)
    assert (p.noise, p.swap, p.temperature, p.dependence) == pytest.approx((0.9, 0.3, 1.6, 0.4))
    with pytest.raises(ValueError):
        synthesizer.Perturbation(swap=1.5)


def test_uniform_blocks_do_not_depend_on_blocking():
    whole = uniform_block(3, "x", np.arange(1000))
    assert np.array_equal(whole[500:], uniform_block(3, "x", np.arange(500, 1000)))
    assert abs(whole.mean() - 0.5) < 0.05 and 0 < whole.min() and whole.max() < 1


def test_crps_of_two_draws():
    assert conditional.crps(np.array([[0.0, 2.0]]), np.array([1.0]))[0] == pytest.approx(1.0 - 0.5)


@pytest.mark.parametrize("family,theta,tau", [("clayton", 2.0, 0.5), ("gumbel", 2.0, 0.5), ("frank", 5.736, 0.5)])
def test_archimedean_copulas_have_their_tau(family, theta, tau):
    for d in (2, 3):
        U = mvdist.copula_block(family, d, theta=theta, seed=2)(np.arange(1500))
        assert (U > 0).all() and (U < 1).all()
        assert latent.kendall_correlations(U)[0, 1] == pytest.approx(tau, abs=0.06)
        assert U.mean(axis=0) == pytest.approx([0.5] * d, abs=0.04)


def test_correlation_matrices():
    assert mvdist.make_corr(3, "ar1", 0.5)[0, 2] == 0.25
    with pytest.raises(ValueError):
        mvdist.make_corr(3, "exchangeable", -0.9)
