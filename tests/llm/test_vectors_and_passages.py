"""Clustering, decontamination and whitening against brute force, and their defined results on odd rows."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest

from sensorgrid.llm import clustering, decontaminate, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, width string, planes string, y string, dims string, ok string"
DOUBLES = VECTORS.replace("array<float>", "array<double>")


def vector_rows(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 1, "a", "b", None, "c", "d", "e") for i, v in rows], schema)


# --- op11 -----------------------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]

    for _ in range(rounds):
        best = nearest()
        for c in range(len(centroids)):
            mine = [v for (_, v), b in zip(kept, best) if b == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine)]
    best = nearest()
    distances = [far(v, centroids[b]) for (_, v), b in zip(kept, best)]
    top = (1 << 63) - 1
    sums = {c: sum(min(d, top) for d, b in zip(distances, best) if b == c) for c in set(best)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, b, min(d, top), min(sums[b], top), min(sum(sums.values()), top), sha[b]) for (i, _), b, d in zip(kept, best, distances)), key=repr)


def check_clusters(spark, rows, schema=VECTORS, **options):
    got = clustering.cluster_vectors(vector_rows(spark, rows, schema), **options).collect()
    want = brute_clusters(rows, options.get("k", 8), options.get("rounds", 10), options.get("scale", 1024))
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(i % 5, 0.4, 64).astype(np.float32).tolist()) for i in range(150)]
    check_clusters(spark, rows)
    check_clusters(spark, rows, k=3, rounds=1, scale=1000)


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    flat = [0.5] * 64
    rows = [(1, flat), (1, flat), (2, flat), (3, [-0.5] * 64), (None, flat), (None, rng.normal(size=64).astype(np.float32).tolist()), (4, None), (5, []),
            (6, [1.0] * 63), (7, [1.0] * 65), (8, [None, *[1.0] * 63]), (9, [float("nan"), *[1.0] * 63]), (10, [float("-inf"), *[1.0] * 63]),
            (11, [0.0] * 64), (11, [1.0] * 64)]
    check_clusters(spark, rows)
    check_clusters(spark, rows[:2])
    assert clustering.cluster_vectors(vector_rows(spark, [])).count() == 0
    assert clustering.cluster_vectors(vector_rows(spark, rows[6:13])).count() == 0


def test_numbers_beyond_64_bits(spark):
    """Very large components go through the same planes; distances are cut, clusters stay exact."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 4 * 5)).tolist()) for i in range(20)] + [(20, [1e307] * 64), (21, [-1e307] * 64), (22, [1e-320] * 64)]
    check_clusters(spark, rows, DOUBLES, k=4, rounds=3)


def test_planes_hold_every_number():
    values = np.array([[0, 1, -1, 5, -8, 7] + [0] * 58, [3] * 64], np.int64)
    width = clustering.bits_needed(values)
    assert width == 4 and (clustering.values_of(clustering.planes_of(values, width)) == values).all()
    assert clustering.square_lengths(clustering.planes_of(values, width)).tolist() == (values**2).sum(axis=1).tolist()


# --- op12 -----------------------------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, n_words string, items string, item_id string, firsts string"
ITEMS = "item_id bigint, text string, words string, doc_id string, windows string"


def brute_hits(docs, items, size):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        words, hit, names = fold(text), set(), set()
        for item, passage in items:
            w = fold(passage)
            for at in range(max(len(w) - size + 1, 1) if w else 0):
                window = w[at:at + size]
                for i in range(len(words) - len(window) + 1):
                    if words[i:i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        names.update([] if item is None else [str(item)])
        listed = ",".join(sorted(names))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


PASSAGES = [(1, "What is the Name of the long river that runs through the old town, and why?"), (2, "a b"), (10, "Ünïcode wörds: äöü ÄÖÜ 42!"),
            (10, "a second text of the same item"), (None, "no name here"), (3, None), (4, ""), (5, "--- ... ---"), (6, "x " * 30), (7, "a a"),
            (8, "what is the name of the long river that runs through the old town, and why?"), (9, "river that runs")]
PAGES = [(1, "He asked: WHAT is the name of the long river that runs\nthrough the old town? And so on."), (1, "a b a b ab a a a"),
         (2, "wörds äöü 42 Ünïcode wörds äöü ÄÖÜ 42"), (None, "no NAME here; no name"), (3, None), (4, ""), (5, "x " * 9 + "y " + "x " * 5000), (6, "x " * 12),
         (7, "the old town and why what is the name"), (8, "\x00a\x7fb\x00"), (9, "café" * 3), (9, "café" * 3), (11, "river that runs " * 4)]


@pytest.mark.parametrize("size", [3, 10])
@pytest.mark.parametrize("limit", [decontaminate.PER_AUTOMATON, 7])
def test_windows_equal_brute_force(spark, size, limit):
    docs = spark.createDataFrame([(i, t, "1", "2", "3", "4") for i, t in PAGES], DOCS)
    items = spark.createDataFrame([(i, t, "1", "2", "3") for i, t in PASSAGES], ITEMS)
    found = decontaminate.find_windows(docs, items, size=size, per_automaton=limit)
    assert sorted((tuple(r) for r in decontaminate.contamination(found).collect()), key=repr) == brute_hits(PAGES, PASSAGES, size)


def test_long_items_are_cut_without_loss(spark):
    """Windows over the seams of the pieces of a long item are found, and a text that covers it is hit whole."""
    long = " ".join(f"w{k * k % 997} v{k}" for k in range(1500))
    docs = spark.createDataFrame([(1, "before " + long + " after"), (2, " ".join(long.split()[995:1012])), (3, "before after")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(decontaminate.find_windows(docs, items)).collect()}
    assert got == {1: (3002, 3000), 2: (17, 17), 3: (2, 0)}


def test_empty_tables_and_places(spark):
    docs = spark.createDataFrame([(i, t, "1", "2", "3", "4") for i, t in PAGES], DOCS)
    items = spark.createDataFrame([(i, t, "1", "2", "3") for i, t in PASSAGES], ITEMS)
    none = decontaminate.contamination(decontaminate.find_windows(docs, items.limit(0))).collect()
    assert len(none) == len(PAGES) and not any(r.contaminated or r.n_items for r in none)
    assert decontaminate.find_windows(docs.limit(0), items).count() == 0
    passages = decontaminate.passages(decontaminate.find_windows(docs, items)).collect()
    for r in passages:
        assert any(i == r.doc_id and t and t[r.start:r.end] == r.passage for i, t in PAGES)
    assert "Ünïcode wörds äöü ÄÖÜ 42" in {r.passage for r in passages}
    assert "WHAT is the name of the long river that runs\nthrough the old town? And" in {r.passage for r in passages}


# --- op13 -----------------------------------------------------------------------------------------------------------------------------


def check_whitening(spark, rows, components=32, schema=VECTORS, close=1e-8):
    """Compares with numpy's eigenvalues; components are compared by what they must satisfy, whatever their sign or basis."""
    got = whitening.whiten(vector_rows(spark, rows, schema), components=components).toPandas()
    finite = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in finite]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d))
    kept = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in finite if len(v) == dims]
    x = np.array([v for _, v in kept], object)
    n, d = len(x), n_times_deviation(x)
    values, vectors = np.linalg.eigh((d.astype(float).T @ d.astype(float)) / n**3)
    values = values[::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    want = min(rank, components)
    assert sorted(got.component.unique()) == list(range(1, want + 1)) and len(got) == n * want
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-6
    top = (1 << 63) - 1
    assert sorted(got[got.component == 1].deviation) == sorted(min(int(v), top) for v in (d * d).sum(axis=1))
    for c, part in got.groupby("component"):
        assert part.explained.nunique() == 1 and abs(part.explained.iloc[0] - values[c - 1] / values.sum()) < 1e-9
    # Scores lie in the span of the deviations and reproduce the whole distance when every component is there.
    if want == rank and not any(i is None for i, _ in kept) and len({i for i, _ in kept}) == n:
        z = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
        gram = (z * values[:want]) @ z.T
        exact = d.astype(float) @ d.astype(float).T / n**2
        assert np.abs(gram - exact).max() < close * np.abs(exact).max()
        for c in range(want):
            if min((abs(values[c] - values[o]) for o in range(len(values)) if o != c), default=1) > 1e-3 * values[0]:
                own = d.astype(float) @ vectors[:, ::-1][:, c] / n / math.sqrt(values[c])
                assert min(np.abs(z[:, c] - own).max(), np.abs(z[:, c] + own).max()) < 1e-7
    return got


def n_times_deviation(x):
    return len(x) * x - x.sum(axis=0)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(6)
    mixing = rng.normal(size=(8, 8))
    rows = [(i, (rng.normal(size=8) @ mixing).astype(np.float32).tolist()) for i in range(120)]
    check_whitening(spark, rows)
    check_whitening(spark, rows, components=3)


def test_whitening_of_repeated_roots_and_lost_rank(spark):
    corners = [(i, [2.0 * (i >> b & 1) - 1 for b in range(5)] + [1.0, 2.0 * (i & 1) - 1]) for i in range(32)]
    got = check_whitening(spark, corners)
    assert got.component.max() == 5
    check_whitening(spark, [(1, [0.5, 2.0]), (2, [1.0, -1.0])])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(30)]
    rows += [rows[0], (None, [1.0, 2.0, 3.0]), (40, None), (41, []), (42, [1.0]), (43, [None, 1.0, 2.0]), (44, [float("nan"), 0.0, 0.0]), (45, [float("inf"), 0.0, 0.0])]
    check_whitening(spark, rows)
    for none in ([], rows[32:34], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(vector_rows(spark, none)).count() == 0


def test_whitening_of_large_numbers(spark):
    """Sums beyond 64 bits stay exact; entries whose whole number is beyond them take no part."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * [1e12, 4e11, 2e11, 1e11]).tolist()) for i in range(40)]
    got = check_whitening(spark, rows, schema=DOUBLES)
    # Eigenvalues 1e28 apart, beyond what numpy can compare with, still give all components.
    far = whitening.whiten(vector_rows(spark, [(i, (rng.normal(size=4) * [1e12, 1e6, 1.0, 0.1]).tolist()) for i in range(40)], DOUBLES)).toPandas()
    assert far.component.max() == 4 and abs(far.groupby("component").explained.first().sum() - 1) < 1e-12
    again = whitening.whiten(vector_rows(spark, [*rows, (99, [1e300, 0.0, 0.0, 0.0])], DOUBLES)).toPandas()
    assert len(again) == len(got) and again.n.iloc[0] == 40


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(9)
    half = rng.integers(-9, 10, (6, 4))
    matrix = (half @ half.T).astype(object)
    poly = whitening.characteristic_polynomial(spark, matrix)
    assert poly[0] == 1 and poly[1] == -int(np.trace(matrix)) and poly[-2:] == [0, 0]
    at = 17
    shifted = np.array([[at * (i == j) - int(matrix[i, j]) for j in range(6)] for i in range(6)], object)
    assert whitening.value_at(poly, at, 0) == determinant(shifted.tolist())
    roots = whitening.largest_roots(poly, 10)
    want = np.linalg.eigvalsh(matrix.astype(float))[::-1][:4]
    assert len(roots) == 4 and np.allclose([r / (1 << b) for r, b, _ in roots], want, rtol=1e-12)
    assert [(r / (1 << b), c) for r, b, c in whitening.largest_roots([1, -7, 16, -12], 3)] == [(3.0, 1), (pytest.approx(2.0, abs=1e-30), 2)]


def determinant(rows):
    if len(rows) == 1:
        return rows[0][0]
    return sum((-1) ** k * v * determinant([r[:k] + r[k + 1:] for r in rows[1:]]) for k, v in enumerate(rows[0]))
