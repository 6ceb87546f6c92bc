import numpy as np

from quillstat.functions import dist


def test_known_values():
    assert np.allclose(dist.norm_ppf(np.array([0.975])), 1.959963984540054, atol=1e-12)
    assert np.allclose(dist.t_ppf(np.array([0.975, 0.975]), np.array([5.0, 30.0])), [2.5705818366147395, 2.0422724563012373], atol=1e-9)
    assert np.allclose(dist.chi2_sf(np.array([3.841458820694124]), np.array([1.0])), 0.05, atol=1e-12)
    assert np.allclose(dist.f_sf(np.array([4.0]), np.array([2.0]), np.array([10.0])), 1.8**-5, atol=1e-12)
    assert np.allclose(dist.binom_cdf(np.array([3.0]), np.array([10.0]), np.array([0.5])), 0.171875, atol=1e-12)


def test_inverses():
    p = np.linspace(0.01, 0.99, 23)
    assert np.allclose(dist.norm_cdf(dist.norm_ppf(p)), p, atol=1e-12)
    assert np.allclose(dist.betainc(2.5, 4.0, dist.beta_ppf(p, 2.5, 4.0)), p, atol=1e-10)
    assert np.allclose(1 - dist.t_sf(dist.t_ppf(p, np.full(23, 3.0)), 3.0), p, atol=1e-10)
