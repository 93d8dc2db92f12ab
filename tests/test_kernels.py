import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.config import IndexConfig, page_layout
from orrery.functions import kernels as K


@pytest.mark.parametrize("dim", [64, 96, 100, 128, 200, 1024])
def test_rotation_keeps_inner_products(dim):
    x = np.random.default_rng(1).standard_normal((7, dim))
    y = K.rotate(x, 3)
    assert y.shape[1] == -(-dim // 64) * 64
    assert np.abs(y @ y.T - x @ x.T).max() < 1e-9
    assert np.allclose(x @ K.rotation_matrix(dim, 3), y)
    q = K.orthonormal_matrix(dim, 3)
    assert np.allclose(q @ q.T, np.eye(dim))


@pytest.mark.parametrize("dim", [3, 63, 4096])
def test_rotation_refuses(dim):
    with pytest.raises(ValueError):
        K.rotate(np.zeros((1, dim)), 0)


def brute_rescale(a, e):
    top = (1 << e) - 1
    end = (top + 10) / a.max()
    start = end * K.RESCALE_START[e]
    ts = sorted({start, *[k / x for x in a if x > 0 for k in range(1, top + 1) if start < k / x < end]})
    best = None
    for t in ts:
        q = np.array([max(k for k in range(top + 1) if k == 0 or (x > 0 and k / x <= t)) for x in a]) + 0.5
        s = a @ q / np.sqrt(q @ q)
        if best is None or s > best[0] + 1e-13:
            best = (s, t)
    return best[1]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_best_rescale_is_brute_force(seed, e):
    a = K.unit_abs(np.random.default_rng(seed).standard_normal((1, 16)))
    assert K.best_rescale(a, e)[0] == pytest.approx(brute_rescale(a[0], e), rel=1e-9)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("prefix", [64, 128])
def test_estimates_near_truth(metric, prefix):
    rng = np.random.default_rng(5)
    x, q, c = rng.standard_normal((200, 128)), rng.standard_normal((20, 128)), rng.standard_normal(128) * 0.1
    near = np.tile(c, (200, 1))
    bits, add, rescale, error = K.onebit(x, near, metric, prefix)
    q_add, q_err = K.query_terms(q, c, metric)
    true = K.distances(x, q, metric)
    est, low = K.onebit_estimate(bits, add, rescale, error, q, q_add, q_err, prefix)
    assert (low > true).mean() < 0.06 and abs((est - true).mean()) < 2
    code, add, rescale = K.ex_codes(x, near, 8, metric)
    assert np.abs(K.ex_estimate(bits, code, add, rescale, q, q_add, 8) - true).max() < 1


def test_zero_residual_has_no_nan():
    x = np.ones((2, 64))
    for metric in ("l2", "ip"):
        for prefix in (None, 64):
            assert all(np.isfinite(v).all() for v in K.onebit(x, x, metric, prefix)[1:])
        assert all(np.isfinite(v).all() for v in K.ex_codes(x, x, 4, metric))
    code, delta, low = K.scalar_quantize(np.zeros((1, 64)), 5, "plain")
    assert np.isfinite(delta).all() and np.isfinite(low).all()


def test_scalar_quantize_gives_back():
    x = np.random.default_rng(2).standard_normal((5, 64))
    code, delta, low = K.scalar_quantize(x, 9, "reconstruction")
    assert np.abs(code * delta[:, None] + low[:, None] - x).max() < 0.05


def test_config_rules():
    assert IndexConfig(100).width == 128 and IndexConfig(64, store="raw").ex_bits == 0
    assert page_layout(IndexConfig(64, store="raw").record_bytes()) == (16, 1) and page_layout(0) == (8, 0) and page_layout(5000) == (1, 2)
    for bad in ({"metric": "cosine"}, {"bits": 0}, {"memdim": 63}, {"store": "x"}, {"bits": 1, "memdim": 64}):
        with pytest.raises(ValueError):
            IndexConfig(128, **bad)


@pytest.mark.parametrize("resident", [1, 3, 9])
def test_resident_bits(resident):
    rng = np.random.default_rng(8)
    x, c, q = rng.standard_normal((50, 64)), np.zeros((50, 64)), rng.standard_normal((5, 64))
    code, _, _ = K.ex_codes(x, c, 8, "l2")
    top, rest = K.split_codes(code, x >= 0, 8, resident)
    assert ((top << (9 - resident)) + rest == code + (x >= 0) * 256).all()
    add, rescale, error = K.resident_factors(x, c, top, resident, "l2")
    q_add, q_err = K.query_terms(q, c[0], "l2")
    est = add[:, None] + q_add + rescale[:, None] * ((top - ((1 << resident) - 1) / 2) @ q.T)
    assert (est - error[:, None] * q_err > K.distances(x, q, "l2")).mean() < 0.05


def test_cells_file(tmp_path, spark):
    from orrery.sources import vector_files as files

    files.write_cells([(3, [1.0, 2.0]), (0, [0.5, 0.0])], str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_cells(spark, str(tmp_path / "c")).collect()] == [(0, 3, [1.0, 2.0]), (1, 0, [0.5, 0.0])]


def test_result_rows(spark, tmp_path):
    from orrery.config import SearchConfig
    from orrery.operators import evaluate as E

    row = E.result_row(spark, IndexConfig(64, metric="ip"), SearchConfig(k=5), {"nq": 3})
    both = E.assemble([row, E.diagnostics_row(spark.createDataFrame([(1, 2, 1, 1)], "clusters long, candidates long, records long, pages long"), "r", 2)])
    assert len(row.columns) == 32 and both.count() == 2 and row.first()["metric_space"] == "ip"
    E.write_csv(row, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == row.columns
    runs = spark.createDataFrame([(10, 2.0, 1.0, 1.5, 0.5, 4e6, 8), (1, 0.0, 0.0, 0.0, 0.0, 0.0, 0)], "queries long, seconds double, coarse_s double, io_s double, drain_s double, io_bytes double, io_reqs long")
    assert [(r["qps"], r["qps_no_coarse"], r["eff_bw_mbps"], r["bound"]) for r in E.throughput(runs).collect()] == [(5.0, 10.0, 2.0, "io"), (None, None, None, "compute")]
    assert E.manifest_row(spark, {"index_id": "x", "build_s": 1.0}, "d", 1, 2).first()["index_ssd_bytes"] == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 30), st.sampled_from(["l2", "ip"]))
def test_nearest_and_smallest_are_exact(seed, n, m, metric):
    """Also among equal rows, whose products differ in their last bits."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 9))[rng.integers(0, n, n)]
    c = x[rng.integers(0, n, m)] + rng.integers(0, 2, (m, 1))
    d = np.array([K.paired(np.tile(a, (m, 1)), c, metric) for a in x])
    if metric == "l2":
        at, dist = K.nearest(x, c)
        assert (at == d.argmin(1)).all() and (dist == d.min(1)).all()
    ids = rng.permutation(n)
    j, i, got = K.smallest(ids, x, c, 5, metric)
    want = [(q, p) for q in range(m) for p in sorted(range(n), key=lambda p: (d[p, q], ids[p]))[:5]]
    assert list(zip(j.tolist(), i.tolist(), strict=True)) == want and (got == d[i, j]).all()


def test_distances_take_little_memory():
    import tracemalloc

    x, c = np.ones((512, 1280)), np.random.default_rng(1).standard_normal((977, 1280))
    tracemalloc.start()
    K.nearest(x, c)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_small_queries():
    rng = np.random.default_rng(6)
    x, q, c = rng.standard_normal((100, 128)), rng.standard_normal((10, 128)), np.zeros(128)
    bits, add, rescale, error = K.onebit(x, np.zeros_like(x), "l2", 128)
    terms = K.query_terms(q, c, "l2")
    whole, small = K.onebit_estimate(bits, add, rescale, error, q, *terms), K.small_query_estimate(bits, add, rescale, error, q, *terms, 8)
    assert np.abs(whole[0] - small[0]).max() < 1.0
    code, delta, low = K.quantize_queries(q)
    assert code.min() == 0 and code.max() == 15 and np.abs(code * delta[:, None] + low[:, None] - q).max() <= delta.max() / 2 + 1e-12


@pytest.mark.parametrize("e", range(1, 9))
def test_packed_codes(e):
    code = np.random.default_rng(e).integers(0, 1 << e, (7, 128))
    packed = K.pack_codes(code, e)
    assert packed.shape == (7, 128 * e // 8) and (K.unpack_codes(packed, 128, e) == code).all()


def test_index_names_and_reports(spark, tmp_path):
    from orrery.operators import evaluate as E

    names = spark.createDataFrame([("deep_C1000_B9_M64_exbits",), ("x_C24_B1_M128_raw",)], "name string")
    assert [tuple(r) for r in names.select(*E.parse_index_name(names["name"])).collect()] == [(1000, 9, 64, "exbits"), (24, 1, 128, "raw")]
    E.write_json(names, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2 and len(list((tmp_path / "r").glob("part-*"))) == 1


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_faster_codes_are_nearly_as_good(metric):
    rng = np.random.default_rng(3)
    x, q, c = rng.standard_normal((200, 128)), rng.standard_normal((10, 128)), np.zeros((200, 128))
    true, q_add = K.distances(x, q, metric), K.query_terms(q, c[0], metric)[0]
    off = {}
    for scale in (None, K.constant_rescale(128, 4, 0)):
        code, add, rescale = K.ex_codes(x, c, 4, metric, scale)
        off[scale is None] = np.abs(K.ex_estimate(x > 0, code, add, rescale, q, q_add, 4) - true).mean()
    assert off[False] < 1.5 * off[True] < 1.5


@pytest.mark.parametrize("e", [1, 4, 8])
def test_bounds_of_all_bits(e):
    rng = np.random.default_rng(e)
    x, q = rng.standard_normal((300, 128)), rng.standard_normal((20, 128))
    bits, _, _, error = K.onebit(x, None, "l2")
    code, add, rescale = K.ex_codes(x, None, e, "l2")
    q_add, q_err = K.query_terms(q, np.zeros(128), "l2")
    dist = K.ex_estimate(bits, code, add, rescale, q, q_add, e)
    low, true = K.ex_lower(dist, error, q_err, e), K.distances(x, q, "l2")
    assert (low > true).mean() < 0.05 and (low <= dist).all()


def test_best_rescale_memory():
    """Eight extra bits of 64 coordinates are 16,320 events a row: a batch of rows stays far below a worker's memory."""
    import tracemalloc

    a = K.unit_abs(np.random.default_rng(0).standard_normal((300, 64)))
    tracemalloc.start()
    K.best_rescale(a, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
