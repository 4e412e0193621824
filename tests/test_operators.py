import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmlake.functions.sequences import CODONS
from swarmlake.operators import annotation, consensus, frequency, landmarks, metadata, mixture, models, pileup, series, swarm

READ = "ref_id long, pos int, mapq int, flag int, has_sa boolean, cigar string, seq string, qual array<int>"


def read(pos, cigar, seq, q=40, mapq=60, flag=0, sa=False):
    return (0, pos, mapq, flag, sa, cigar, seq, [q] * len(seq) if isinstance(q, int) else q)


def test_codon_windows_stay_within_elements(spark):
    df = spark.createDataFrame([read(1, "3M3X", "ACGTAC")], READ)
    assert sorted((r["position"], r["codon"]) for r in pileup.codon_counts(df).collect()) == [(1, "ACG"), (4, "TAC")]


def test_quality_mask_merges(spark):
    df = spark.createDataFrame([read(1, "3M", "AAA", [40, 20, 35])] * 2 + [read(1, "3M", "AAA", [40, 10, 35])] * 3 + [read(1, "3M", "AAA", [10, 10, 10])], READ)
    rows = pileup.codon_counts(df, threshold=30).collect()
    assert [(r["q1"], r["q2"], r["q3"], r["n"]) for r in rows] == [(40, 0, 35, 5)]


def test_unambiguous(spark):
    rows = [(0, 1, "AAA", 40, 40, 40, 1), (0, 1, "AAC", 40, 40, 0, 1), (0, 1, "CAA", 40, 40, 0, 1)]
    df = spark.createDataFrame(rows, "ref_id long, position int, codon string, q1 int, q2 int, q3 int, n long")
    assert sorted(r["codon"] for r in pileup.unambiguous(df).collect()) == ["AAA", "AAC"]


def test_coverage(spark):
    ref = spark.createDataFrame([(0, i) for i in range(1, 6)], "ref_id long, position int")
    df = spark.createDataFrame([read(1, "3M", "AAA"), read(2, "3M", "AAA"), read(2, "3M", "AAA", flag=4), read(2, "3M", "AAA", mapq=5), read(2, "3M", "AAA", sa=True)], READ)
    assert [r["coverage"] for r in pileup.coverage(df, ref).orderBy("position").collect()] == [1, 2, 2, 1, 0]


def test_consensus_with_indels(spark):
    ref = spark.createDataFrame([(0, i, b) for i, b in enumerate("AAAAAA", 1)], "ref_id long, position int, base string")
    deleted = spark.createDataFrame([read(1, "2M2D2M", "CCGG")] * 2, READ)
    assert consensus.sequences(consensus.events(deleted), ref).first()["sequence"] == "CCGG"
    inserted = spark.createDataFrame([read(1, "2M2I2M", "CCTTGG")] * 2, READ)
    assert consensus.sequences(consensus.events(inserted), ref).first()["sequence"] == "CCTTGGAA"
    tied = spark.createDataFrame([read(1, "1M", "C"), read(1, "1M", "T")], READ)
    assert consensus.bases(consensus.events(tied), ref).orderBy("position").first()["base"] == "C"


def test_likelihood_maximum():
    rng = np.random.default_rng(1)
    seen = list(rng.choice(["AAA", "AAC", "GGG"], 400, p=[0.6, 0.3, 0.1]))
    q = rng.integers(30, 41, (400, 3))
    rcc = frequency.likelihoods(seen, q, CODONS)
    n = np.ones(400)
    start = np.array([seen.count(c) / 400 for c in CODONS])
    x = frequency.solve(rcc, n, start)
    assert abs(x.sum() - 1) < 1e-9 and frequency.residual(rcc, n, x) < 1e-4
    assert abs(x[CODONS.index("AAA")] - start[CODONS.index("AAA")]) < 0.02


def random_position(rng, k):
    m = int(rng.integers(1, 150))
    true = rng.choice(64, m, p=rng.dirichlet(np.full(64, 0.05)))
    q = rng.integers(5, 41, (m, 3))
    if k % 3 == 0:
        q[rng.random((m, 3)) < 0.2] = 0
    seen = [CODONS[i] for i in (rng.integers(0, 64, m) if k % 2 else true)]
    n = rng.integers(1, 20, m).astype(float)
    start = np.bincount([CODONS.index(c) for c in seen], n, 64)
    return frequency.likelihoods(seen, q, CODONS), n, start / start.sum()


def test_newton_meets_the_optimality_conditions():
    """On positions of few states and of noise, with masked qualities; no round limit ends it."""
    rng = np.random.default_rng(0)
    for k in range(60):
        rcc, n, start = random_position(rng, k)
        x = frequency.solve(rcc, n, start)
        g = frequency.gradient(rcc, n, x)
        assert abs(x.sum() - 1) < 1e-12 and (x >= 0).all() and frequency.residual(rcc, n, x) < 1e-6
        assert np.abs(g[x > 0] + 1).max() < 1e-5 and g.min() > -1 - 1e-5


def test_states_are_taken_in_again():
    """A state that the start leaves out, but the maximum needs."""
    rcc, n = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]), np.array([5.0, 4.0, 1.0])
    for method in ("newton", "gradient"):
        x = frequency.solve(rcc, n, np.array([1.0, 0.0, 0.0]), method)
        assert frequency.residual(rcc, n, x) < 1e-6 and (x > 0).sum() == 3


def test_gradient_and_hessian():
    rng = np.random.default_rng(2)
    rcc, n, start = random_position(rng, 1)
    x, h = np.full(64, 1 / 64), 1e-6
    some = [0, 7, 63]
    for i in some:
        up, down = x.copy(), x.copy()
        up[i] += h
        down[i] -= h
        assert abs((frequency.objective(rcc, n, up) - frequency.objective(rcc, n, down)) / (2 * h) - frequency.gradient(rcc, n, x)[i]) < 1e-5
        change = (frequency.gradient(rcc, n, up) - frequency.gradient(rcc, n, down)) / (2 * h)
        assert np.allclose(change, frequency.hessian(rcc, n, x)[i], rtol=1e-4, atol=1e-4)
    slow = frequency.solve(rcc, n, start, "gradient", rounds=5000)
    assert abs(frequency.objective(rcc, n, slow) - frequency.objective(rcc, n, frequency.solve(rcc, n, start))) < 1e-9


def test_detection_limit(spark):
    cell = "sample_id long, ref_id long, position int, codon string, freq double"
    both = spark.createDataFrame([(0, 0, 1, "AAA", 0.99), (0, 0, 1, "CCC", 0.005)], cell)
    forward = spark.createDataFrame([(0, 0, 1, "CCC", 0.01), (0, 0, 1, "AAA", 0.99)], cell)
    reverse = spark.createDataFrame([(0, 0, 1, "AAA", 0.99)], cell)
    got = {r["codon"]: r["lod"] for r in swarm.detection_limit(both, forward, reverse, F.lit(0)).collect()}
    assert got["AAA"] == 1e-6 and abs(got["CCC"] - 0.02) < 1e-3


def test_features(spark):
    f = spark.createDataFrame([("long", 1, 100, 1), ("short", 10, 20, 2), ("same", 10, 20, 3)], "feature string, start int, end int, row_no long")
    p = spark.createDataFrame([(5,), (15,), (200,)], "position int")
    assert {r["position"]: r["feature"] for r in annotation.feature_at(p, f).collect()} == {5: "long", 15: "short", 200: ""}


def test_series(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 2.0), (1, 3.0, 4.0)], "id int, t double, v double")
    assert abs(series.means(s, ["id"]).first()["mean"] - 7 / 3) < 1e-12
    assert [r["v"] for r in series.at_steps(s, ["id"], 0.5).orderBy("t").collect()] == [0, 1, 2, 2.5, 3, 3.5, 4]
    m = spark.createDataFrame([(1, float(i), v) for i, v in enumerate([1.0, 9.0, 2.0, 3.0])], "id int, t double, v double")
    assert [r["v"] for r in series.median_filtered(m, ["id"], 1).orderBy("t").collect()] == [1, 2, 3, 3]


def test_distance_curve(spark):
    rows = [(1, "x", 0.0, 0.0), (1, "x", 4.0, 4.0), (1, "y", 0.0, 0.0), (1, "y", 2.0, 0.0), (1, "y", 4.0, 0.0)]
    s = spark.createDataFrame(rows, "id int, kind string, t double, v double")
    curve = series.distance_curve(s, ["id"], "kind", "x", "y")
    assert [(r["t_start"], r["t_end"], r["c"], r["b"], r["a"]) for r in curve.orderBy("seg").collect()] == [(0, 2, 0, 0, 1), (2, 4, 4, 4, 1)]
    assert abs(series.curve_means(curve, ["id"]).first()["mean"] - 2) < 1e-9
    assert abs(series.bifurcations(curve, ["id"], 3.0).first()["t"] - 3) < 1e-9
    assert series.bifurcations(curve, ["id"], 9.0).first()["t"] is None


def test_values_at_asked_times(spark):
    """On, between and outside marks, with stretches in which there is none, for arrays and unknown ids."""
    s = spark.createDataFrame([(1, 0.0, [0.0, 1.0]), (1, 10.0, [5.0, 1.0]), (1, 11.0, [6.0, 3.0]), (2, 5.0, [7.0, 7.0]), (None, 0.0, [1.0, 1.0])], "id int, t double, v array<double>")
    asked = spark.createDataFrame([(1, -3.0, "a"), (1, 0.0, "b"), (1, 4.0, "c"), (1, 10.5, "d"), (1, 11.0, "e"), (1, 99.0, "f"), (2, 1.0, "g"), (2, 9.0, "h"), (3, 1.0, "i"), (None, 1.0, "j"), (1, 4.0, "c")], "id int, t double, name string")
    want = {"a": [0, 1], "b": [0, 1], "c": [2, 1], "d": [5.5, 2], "e": [6, 3], "f": [6, 3], "g": [7, 7], "h": [7, 7], "i": None, "j": [1, 1]}
    for width in (None, 2.0):
        rows = series.values_at(s, asked, ["id"], clamp=True, width=width).collect()
        assert len(rows) == 11 and {r["name"]: r["value"] for r in rows} == want
    inside = asked.filter("name in ('b', 'c', 'd', 'e')")
    assert {r["name"]: r["value"] for r in series.values_at(s, inside, ["id"]).collect()} == {k: want[k] for k in "bcde"}
    for name in "afgi":
        with pytest.raises(Exception, match="no value at"):
            series.values_at(s, asked.filter(F.col("name") == name), ["id"]).collect()


def test_curve_in_two_dimensions(spark):
    rows = [(1, "x", 0.0, [0.0, 0.0]), (1, "x", 4.0, [4.0, 0.0]), (1, "y", 0.0, [0.0, 0.0]), (1, "y", 4.0, [0.0, 3.0])]
    curve = series.distance_curve(spark.createDataFrame(rows, "id int, kind string, t double, v array<double>"), ["id"], "kind", "x", "y")
    assert [(r["c"], r["b"], r["a"]) for r in curve.collect()] == [(0, 0, 1 + 9 / 16)]
    asked = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 2.0, 4.0, 4.5)], "id int, t double")
    assert [r["distance"] for r in series.curve_values(curve, asked, ["id"]).orderBy("t").collect()] == [None, 0, 2.5, 5, None]


def test_nearest_of_categories(spark):
    rows = [(1, "a", "b", None, 1.0), (2, "a", "b", None, 3.0), (3, "a", "c", None, 5.0), (4, "x", "y", "z", 7.0), (5, "a", "c", "q", 9.0)]
    df = spark.createDataFrame(rows, "id long, p string, q string, r string, fitness double")
    got = {r["id"]: (r["differing"], r["ties"], r["predicted"]) for r in models.categorical_nearest(df, df, ["p", "q", "r"], "id").collect()}
    assert got == {1: (0, 1, 3.0), 2: (0, 1, 1.0), 3: (1, 3, 13 / 3), 4: (3, 4, 4.5), 5: (1, 1, 5.0)}


def test_equal_distances_may_take_any_order():
    """Scaling a square by its ranks leaves no stress: its four sides are equal, and so are its diagonals."""
    x = np.array([[0, 0], [1, 0.1], [1, 1], [0, 1.05]])
    d = np.array([[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]], dtype=float)
    _, stress = landmarks.nonmetric_scaling(d, x)
    assert stress < 1e-3


def test_linear_algebra():
    assert landmarks.isotonic(np.array([3.0, 1.0, 2.0])).tolist() == [2, 2, 2]
    d = np.array([[0, 1, 4], [1, 0, 6], [4, 6, 0]], dtype=float)
    assert landmarks.average_linkage(d) == [(1, 2, 2, 1.0), (3, 4, 3, 5.0)]
    e = np.array([[0, 1, np.inf], [1, 0, 2], [np.inf, 2, 0]])
    assert landmarks.all_paths(e)[0, 2] == 3
    x = np.array([[0, 0], [3, 0], [0, 4], [3, 4]], dtype=float)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = landmarks.classical_scaling(full, 2)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), full)
    apart = np.where(np.abs(np.subtract.outer([0, 1, 8, 9], [0, 1, 8, 9])) <= 1, 1.0, np.inf)
    assert np.isfinite(landmarks.all_paths(landmarks.connected(apart, np.abs(np.subtract.outer([0.0, 1, 8, 9], [0, 1, 8, 9]))))).all()


def test_group_models(spark):
    p = spark.createDataFrame([(1, 0, [0.0], 1.0), (2, 0, [0.0], 3.0), (3, 1, [5.0], 5.0)], "vec_id long, label int, x array<double>, fitness double")
    assert {r["vec_id"]: r["predicted"] for r in models.group_means(p, True).collect()} == {1: 3.0, 2: 1.0, 3: None}


def test_metadata(spark):
    m = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("d", None, 4)], "sample_id string, reference int, row int")
    assert metadata.filtered(m, "nothing").columns == []
    assert metadata.filtered(m, ("reference", 1), ("row", [1, 3])).count() == 2
    fit = spark.createDataFrame([(1, "b", 1, 10.0), (2, None, 1, 20.0), (3, None, 1, 30.0)], "fit_row int, sample_id string, reference int, fitness double")
    got = {r["sample_id"]: r["fitness"] for r in metadata.fitness_joined(m, fit, "sample_id", ["reference"], "row").collect()}
    assert got == {"a": 20.0, "b": 10.0, "c": 30.0, "d": None}
    r = spark.createDataFrame([(None, 2.0, 4.0), (None, None, None)], "a double, b double, c double").select(metadata.mean_of_known("a", "b", "c").alias("m")).collect()
    assert [x["m"] for x in r] == [3.0, None]


def test_mixture(spark):
    codons = [(0, 1, "AAA"), (1, 1, "CCC"), (0, 2, "GGG"), (1, 2, "GGG"), (0, 3, "AAC"), (1, 3, "TTT"), (0, 4, "ACA"), (1, 4, "TGT")]
    refs = spark.createDataFrame(codons, "ref_id long, position int, ref_codon string")
    cells = [(7, p, c, f) for r, p, c in codons if p != 2 for f in [0.8 if r == 0 else 0.2]] + [(7, 2, "GGG", 1.0), (8, 1, "CCC", 0.5), (8, 1, "TTA", 0.5)]
    swarms = spark.createDataFrame(cells, "sample_id long, position int, codon string, freq double")
    got = {(r["sample_id"], r["ref_id"]): r["proportion"] for r in mixture.estimated(swarms, refs).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {(7, 0): 0.8, (7, 1): 0.2, (8, 0): 0.0, (8, 1): 1.0}
    assert [r["sample_id"] for r in mixture.pure(mixture.estimated(swarms, refs)).collect()] == [8]


def test_nonmetric_scaling():
    x = np.random.default_rng(3).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y, stress = landmarks.nonmetric_scaling(d**3, landmarks.classical_scaling(d, 2))
    assert stress < 0.02 and y.shape == (12, 2)


def test_closest_reference(spark):
    refs = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTTTTT")], "ref_id long, sequence string")
    rows = [("same", 1, "ACGTACGT"), ("other", 1, "ACGTTTTA"), ("gap", 2, "ACGTTTT")]
    got = {r["sample_id"]: tuple(r)[2:] for r in consensus.closest_references(spark.createDataFrame(rows, "sample_id string, ref_id long, sequence string"), refs).collect()}
    assert got == {"same": (1, 0.0, False, False), "other": (2, 1.0, False, True), "gap": (2, 10.0, True, False)}


def test_points_are_placed_by_landmarks(spark):
    """On a plane, paths that are straight lines give back the distances."""
    rng = np.random.default_rng(7)
    at, x = rng.normal(size=(8, 2)), rng.normal(size=(30, 2))
    paths = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([at, x]))], "vec_id long, x array<double>")
    scaled = landmarks.classical_scaling(paths, 2)
    got = {r["vec_id"]: np.array(r["place"]) for r in landmarks.placed(points, at.tolist(), paths, scaled, near=1).collect()}
    assert np.allclose([got[i] for i in range(8)], scaled)
    among = {r["vec_id"]: np.array(r["place"]) for r in landmarks.placed_among(points, at.tolist(), scaled).collect()}
    assert np.allclose([among[i] for i in range(8)], scaled, atol=1e-6)
    for i, p in enumerate(x):
        d = np.sqrt(((at - p) ** 2).sum(1))
        through = d[d.argmin()] + paths[d.argmin()]
        assert np.allclose(got[8 + i], -np.linalg.pinv(scaled) @ (through**2 - (paths**2).mean(0)) / 2)


def test_cut_tree():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    assert landmarks.cut_tree(landmarks.average_linkage(d), 4, 2) == [0, 0, 2, 2]
    assert landmarks.cut_tree(landmarks.average_linkage(d), 4, 9) == [0, 1, 2, 3]


def test_metadata_of_samples(spark):
    samples = spark.createDataFrame([(1, "WT_a"), (0, "Stop_b")], "place int, sample string")
    named = metadata.reference_by_pattern(samples, "sample", {"^WT": "WT", "^Stop": "Stop"})
    assert {r["sample"]: r["reference"] for r in named.collect()} == {"WT_a": "WT", "Stop_b": "Stop"}
    for patterns in ({"^WT": "WT"}, {"^WT": "WT", "^S": "Stop", "b$": "Other"}):
        with pytest.raises(Exception, match="not one pattern for sample Stop_b"):
            metadata.reference_by_pattern(samples, "sample", patterns).collect()
    doses = spark.createDataFrame([("RBV", 50), ("RBV", 1), (None, 50)], "mutagen string, dose int")
    level = metadata.level_of(["mutagen", "dose"], {("RBV", 50): "Low", ("RBV", 300): "High"})
    assert [r["level"] for r in doses.select(level.alias("level")).collect()] == ["Low", None, None]
    rows = spark.createDataFrame([("Stop_b", None), ("WT_a", 7), ("z", 8)], "sample string, passage int")
    assert [tuple(r) for r in metadata.in_order_of(samples, rows, "sample").orderBy("place").select("sample", "passage").collect()] == [("Stop_b", None), ("WT_a", 7)]
    with pytest.raises(Exception, match="no metadata for WT_a"):
        metadata.in_order_of(samples, rows.filter("sample = 'z'"), "sample").filter("place = 1").collect()
    metadata.check_same_sites(samples, samples.unionByName(samples), ["sample"])
    with pytest.raises(ValueError):
        metadata.check_same_sites(samples, rows, ["sample"])


def test_base_frequencies_by_sample_at_all_sites(spark):
    rows = [(s, 0, 1, b, 30, n) for s, b, n in ((1, "A", 90), (1, "C", 10), (2, "G", 5))]
    counts = spark.createDataFrame(rows, "sample_id long, ref_id long, position int, nuc string, q int, n long")
    keys = ("sample_id", "ref_id")
    found = frequency.estimated(counts, list("ACGT"), keys=keys, seen="nuc")
    sites = spark.createDataFrame([(s, 0, p) for s in (1, 2) for p in (1, 2)], "sample_id long, ref_id long, position int")
    got = {(r["sample_id"], r["position"], r["nuc"]): r for r in frequency.at_all_sites(found, sites, keys).collect()}
    assert set(got) == {(1, 1, "A"), (1, 1, "C"), (1, 2, None), (2, 1, "G"), (2, 2, None)}
    assert all(r["converged"] for r in got.values()) and got[1, 2, None]["coverage"] == 0 and got[1, 1, "A"]["coverage"] == 100
    # errors of 1 in 3000 for each other base: the share p seen of C solves p (1 - e) + (1 - p) e / 3 = 0.1
    e = 1e-3
    assert abs(got[1, 1, "C"]["freq"] - (0.1 - e / 3) / (1 - 4 * e / 3)) < 1e-3


def test_codon_numbers_and_grid(spark):
    df = spark.createDataFrame([(10, 10, 18), (16, 10, 18)], "p int, s int, e int")
    number = annotation.codon_number(F.col("p"), F.col("s"), F.col("e"))
    assert [r["n"] for r in df.select(number.alias("n")).collect()] == [1, 3]
    with pytest.raises(Exception, match="starts at 11"):
        df.filter("p = 10").select(annotation.codon_number(F.col("p") + 1, F.col("s"), F.col("e"))).collect()
    reference = spark.createDataFrame([(0, i + 1, b) for i, b in enumerate("AAATTTCC")], "ref_id long, position int, base string")
    features = spark.createDataFrame([("f", 1, 6, 0)], "feature string, start int, end int, row_no long")
    labels = [r["label"] for r in annotation.variant_grid(reference, features).collect()]
    assert len(labels) == 128 and "f-K1K" in labels and "f-F2K" in labels
