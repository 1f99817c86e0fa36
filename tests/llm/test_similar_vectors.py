import numpy as np

from lodeline.llm import similar_vectors as sv


def _rows(n=400, dim=64, seed=0):
    r = np.random.RandomState(seed)
    c = r.randn(n // 8, dim)
    v = (c[np.arange(n) % len(c)] + 0.4 * r.randn(n, dim)).astype(np.float16).astype(float)
    return [(i, x.tolist()) for i, x in enumerate(v)]


def _brute(rows, k=5):
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    s = np.round(x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 12)
    np.fill_diagonal(s, -9)
    return {(int(ids[q]), int(ids[o])) for q in range(len(ids)) for o in np.lexsort((ids, -s[q]))[: min(k, len(ids) - 1)]}


def _found(spark, rows, shards=((0, 10_000),), cell=None):
    v = spark.createDataFrame(rows, "job_index long, embedding array<float>")
    s = spark.createDataFrame([("p", a, b) for a, b in shards], "vectors_path string, row_start long, row_end long")
    return {(r["job_index"], r["other"]) for r in sv.neighbours(v, s, 5, 64, **({"cell": cell} if cell else {})).collect()}


def test_recall_in_one_cell_and_in_many(spark):
    rows = _rows()
    want = _brute(rows)
    for cell in (None, 60):
        got = _found(spark, rows, cell=cell)
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_cases(spark):
    rows = _rows(40)
    odd = [(100, None), (101, [1.0]), (102, [0.0] * 64), (103, [float("nan")] * 64), (104, [float("inf")] + [1.0] * 63), (105, [None] + [1.0] * 63), rows[3], (900, rows[0][1])]
    got = _found(spark, rows + odd, shards=((0, 500),))
    assert {a for a, _ in got} == set(range(40)) and got == _brute(rows)
    assert _found(spark, []) == set()
    assert _found(spark, rows[:3]) == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_ties_go_to_the_smaller_number(spark):
    v = [1.0] + [0.0] * 63
    got = _found(spark, [(i, v) for i in range(9)])
    assert {b for a, b in got if a == 8} == {0, 1, 2, 3, 4} and {b for a, b in got if a == 0} == {1, 2, 3, 4, 5}


def test_equal_vectors_in_a_hot_cell(spark):
    got = _found(spark, [(i, [1.0] + [0.0] * 63) for i in range(200)], cell=30)
    assert all(len([1 for a, _ in got if a == q]) == 5 for q in range(200)) and {b for a, b in got if a == 150} == {0, 1, 2, 3, 4}


def test_copies_of_a_vector_over_several_pieces(spark):
    rows = _rows(80)
    for seed in range(3):
        v = np.random.RandomState(seed).randn(64).astype(np.float16).astype(float).tolist()
        some = [(1_000 + i, v) for i in range(200)] + [(2_000 + i, rows[7][1]) for i in range(3)]
        odd = [(300 + i, [(0.0, float("nan"), float("inf"))[i % 3]] * 64) for i in range(6)] + [(5, rows[5][1]), (500, rows[9][1])]
        got = _found(spark, rows + some + odd, shards=((0, 400), (1_000, 3_000)), cell=30)
        for q in range(1_000, 1_200):
            assert {b for a, b in got if a == q} == {i for i in range(1_000, 1_006) if i != q} - ({1_005} if q > 1_004 else set())
        want = _brute(rows + some)
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
        assert all({b for a, b in got if a == q} >= {7, 2_000, 2_001, 2_002} - {q} for q in (7, 2_000, 2_001, 2_002))


def test_unusable_rows_dont_displace_a_usable_one_of_their_job_index(spark):
    rows = _rows(40)
    odd = [(i, [u] * 64) for i in range(40) for u in (0.0, float("nan"), float("inf"))] + [(50, [0.0] * 64), (50, [float("nan")] * 64)]
    assert _found(spark, rows + odd + [(3, [None] + [1.0] * 63)]) == _brute(rows)


def test_a_similarity_above_one_is_no_negative_distance():
    best = sv.Best(np.arange(1), np.ones((1, 2)), np.ones((1, 2)), 1)
    best.add(np.array([0]), np.array([3]), np.array([1.0000002], np.float32))
    assert best.kth()[0] == 0


def test_chi_square():
    assert abs(sv.chi2_quantile(0.95, 10) - 18.307) < 0.05 and abs(sv.chi2_quantile(0.97, 96) - 123.3) < 0.6


def test_parallel_vectors_of_different_lengths(spark):
    """More vectors of nearly one direction than places, apart by less than single precision shows: the exact five come out."""
    r = np.random.RandomState(6)
    base = r.randn(64)
    exact = [(i, (base * (1 + i)).tolist()) for i in range(40)]
    rounded = [(100 + i, (base * s).astype(np.float16).astype(float).tolist()) for i, s in enumerate(np.linspace(0.5, 3, 40))]
    rows = exact + rounded + [(500 + i, v) for i, v in _rows(200, seed=9)]
    got = _found(spark, rows)
    as_given = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    want = {(a, b) for a, b in _brute(as_given) if a < 200}
    assert {(a, b) for a, b in got if a < 200} == want


def test_settling_in_between_loses_nothing(monkeypatch):
    monkeypatch.setattr(sv, "SPILL", 2)
    r = np.random.RandomState(1)
    base = r.randn(64)
    v = np.stack([base * s for s in r.uniform(0.5, 3, 300)] + [r.randn(64) for _ in range(100)]).astype(np.float16)
    ids = r.permutation(400).astype(np.int64)
    index = sv.CellIndex(ids, v)
    order = np.argsort(index.ids)
    got, _, _ = index.search(index.ids[order], index.raw[order], np.full(400, 4, np.float32), 5)
    want = _brute([(int(i), x.astype(float)) for i, x in zip(ids, v, strict=True)])
    near = set(ids[:300].tolist())
    assert all({(q, int(o)) for o in got[q]} == {(a, b) for a, b in want if a == q} for q in near)


def test_ranges_of_any_number(spark):
    rows = spark.range(300_000).withColumnRenamed("id", "job_index")
    shards = spark.createDataFrame([("a", 0, 10), ("b", 65_530, 65_540), ("c", 131_000, 262_200), ("d", 5, 7), ("e", 9, 3)], "vectors_path string, row_start long, row_end long")
    assert sv.within(rows, shards).count() == 10 + 10 + 131_200
    many = spark.range(0, 250_000).selectExpr("'p' as vectors_path", "id * 2 as row_start", "id * 2 + 1 as row_end")
    assert sv.within(rows, many).count() == 150_000


def test_few_cells_are_reached_where_vectors_form_groups():
    """The neighbours' cells lie behind near planes; boxes of a kd-tree over eight projections reached nearly all cells."""
    rows = _rows(1_600, 256)
    x = sv.unit(np.array([v for _, v in rows]))
    centres, sizes = sv.fit_centres(x, 20)
    own = sv.nearest_centre(x, centres)
    assert len(centres) == 20 and sizes.sum() == 1_600 and (np.bincount(own, minlength=20) == sizes).all()
    away = sv.plane_distance(x, own, centres)
    other, dist = np.array(sorted(_brute(rows)))[:, 1].reshape(1_600, 5), np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    # no vector of a cell is nearer than the plane before it
    assert all((away[:, own[o]] <= dist[:, o] + 1e-3).all() for o in range(0, 1_600, 50))
    kth = np.take_along_axis(dist, other, 1).max(1)
    probes = np.random.RandomState(5).permutation(1_600)[: sv.PROBES]  # at random: the groups recur at a fixed step
    part = (np.take_along_axis(away, own[other], 1) / kth[:, None])[probes].max()
    reached = away <= part * kth[:, None]
    assert reached.mean() < 0.3 and np.take_along_axis(reached, own[other], 1).mean() > 0.995
