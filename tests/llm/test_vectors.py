"""The two operators on embeddings against plain versions, and their results for odd tables."""

import hashlib
import math

import numpy as np
import pytest

from jobledger.llm import bidiagonal, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = "x string, code string, codes date, error string, n string, row string, key int, of int, places int, sizes int"


def table(spark, n=300, width=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype(np.float32) * np.linspace(0.1, 2, width).astype(np.float32)
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all vectors are equal
    data = [(i, list(map(float, x)), None if i % 7 == 0 else i % 3) for i, x in enumerate(v)]
    odd = [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] + [0.0] * (width - 1), None)]
    odd += [(None, data[5][1], None), data[-1], data[-1]]
    return data + odd, spark.createDataFrame(data + odd, SCHEMA).repartition(5)


def finite_rows(data):
    return [r for r in data if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def plain_codes(data, parts=8, entries=16, rounds=6):
    rows = [(i, [math.floor(4096 * c) for c in v], label) for i, v, label in finite_rows(data)]
    width = len(rows[0][1]) // parts
    cut = lambda x, p: tuple(x[p * width : (p + 1) * width])
    first = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]

    def nearest(x, p):
        distances = [sum((a - b) ** 2 for a, b in zip(cut(x, p), entry)) for entry in books[p]]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, x, _ in rows:
                own[nearest(x, p)[0]].append(cut(x, p))
            new.append([tuple(sum(c) // len(o) for c in zip(*o)) if o else entry for o, entry in zip(own, books[p])])
        books = new
    coded = [(i, "".join(f"{nearest(x, p)[0]:02x}" for p in range(parts)), sum(nearest(x, p)[1] for p in range(parts)), label) for i, x, label in rows]
    of = {}
    for _, _, error, label in coded:
        of[label] = of.get(label, 0) + error
    return [(i, code, error, of[label]) for i, code, error, label in coded], [c for book in books for entry in book for c in entry]


def found_codes(df):
    found = vector_codes.compress(df)
    rows = vector_codes.with_label_error(found.rows).selectExpr("vec_id", "lower(hex(codes))", "error", "label_error").collect()
    return sorted(map(tuple, rows), key=repr), found.codebooks.ravel().tolist()


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_codes_equal_the_plain_version(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block_rows)
    data, df = table(spark)
    want, books = plain_codes(data)
    assert found_codes(df) == (sorted(want, key=repr), books)


def test_codes_of_fewer_rows_than_entries(spark):
    data, _ = table(spark, n=6)
    df = spark.createDataFrame(data, SCHEMA)
    want, books = plain_codes(data)
    assert found_codes(df) == (sorted(want, key=repr), books)


@pytest.mark.parametrize("width", [8, 64])
def test_ties_go_to_the_lower_index(spark, width):
    df = spark.createDataFrame([(i, [float(i % 2)] * width, None) for i in range(20)], SCHEMA)
    rows, _ = found_codes(df)
    assert {(r[0] % 2, r[1]) for r in rows} == {(0, "00" * 8), (1, "01" * 8)}


def test_odd_tables(spark):
    data, df = table(spark, n=40)
    clashing = df.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASHES.split(", ")])
    assert found_codes(clashing) == found_codes(df)
    assert whitening.whiten(clashing).count() == whitening.whiten(df).count() == 16 * len(finite_rows(data))
    for nothing in (df.limit(0), df.where("vec_id = 40"), spark.createDataFrame([(None, None, None)], SCHEMA)):
        assert found_codes(nothing) == ([], [])
        assert whitening.whiten(nothing).collect() == [] and whitening.whiten(nothing).columns == whitening.whiten(df).columns
    for wrong in ([1.0] * 12, [1e30] * 16, []):
        with pytest.raises(Exception, match="vectors must have|components must be"):
            found_codes(spark.createDataFrame([(0, wrong, 1)], SCHEMA))


def plain_whitening(data, components=32):
    rows = finite_rows(data)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [r[0] for r in rows], n, deviation, centred @ vectors / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize("width, n", [(16, 300), (48, 400)])
def test_whitening_equals_the_plain_version(spark, width, n):
    data, df = table(spark, n, width)
    ids, count, deviation, plain, share = plain_whitening(data)
    found = whitening.whiten(df).collect()
    k = min(32, width)
    assert len(found) == k * len(ids) and {r["n"] for r in found} == {count}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    want = {}
    for i, d, w in zip(ids, deviation, plain):
        want.setdefault(repr(i), []).append((d, w))
    signs = {}
    for r in found:
        d, w = want[repr(r["vec_id"])][0]  # rows with one id are equal here
        assert r["deviation"] == d and math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9)
        value = w[r["component"] - 1]
        if abs(value) > 1e-3:
            signs.setdefault(r["component"], set()).add(round(r["whitened"] / value, 6))
    assert len(signs) == k and all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_directions_without_variance_have_no_rows(spark):
    flat = [(i, [float(i % 5), 1.0, float(i % 3), 2.0, float(i % 5)], None) for i in range(60)]
    found = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2} and len(found) == 120 and found[0]["identity_error"] < 1e-9
    assert math.isclose(sum({r["explained"] for r in found}), 1, rel_tol=1e-9)
    equal = spark.createDataFrame([(i, [1.0, 2.0], None) for i in range(9)], SCHEMA)
    assert whitening.whiten(equal).collect() == []


def test_sums_beyond_64_bits_are_exact(spark):
    x = np.array([[(1 << 51) - 1, -(1 << 51)], [5, 7]])
    assert whitening._exact_sums(np.repeat(x, 5000, axis=0)) == [5000 * ((1 << 51) + 4), 5000 * (7 - (1 << 51))]
    fit = whitening.Fit(1 << 40, (3 << 60, -(5 << 60)))
    assert fit.deviations(x).tolist() == [[(int(v) << 40) - s for v, s in zip(row, fit.sums)] for row in x]


MATRICES = {
    "random": lambda r: r.normal(size=(64, 64)),
    "one": lambda r: r.normal(size=(1, 1)),
    "zero": lambda r: np.zeros((8, 8)),
    "identity": lambda r: np.eye(64),
    "dependent columns": lambda r: r.normal(size=(40, 20)) @ r.normal(size=(20, 40)),
    "zero columns": lambda r: r.normal(size=(30, 30)) * (np.arange(30) % 4 > 0),
    "graded": lambda r: np.diag(10.0 ** np.linspace(0, -12, 50)) @ np.linalg.qr(r.normal(size=(50, 50)))[0],
    "multiple": lambda r: np.diag(np.repeat(np.arange(16, 0, -1.0), 4)) @ np.linalg.qr(r.normal(size=(64, 64)))[0],
    "close": lambda r: np.diag(1 + 1e-6 * np.arange(64)) @ np.linalg.qr(r.normal(size=(64, 64)))[0],
    "nearly equal": lambda r: np.diag(1 + 1e-13 * np.arange(64)) @ np.linalg.qr(r.normal(size=(64, 64)))[0],
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_vectors(name):
    a = np.linalg.qr(MATRICES[name](np.random.default_rng(5)))[1]
    squares, vectors = bidiagonal.right_singular(a)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    size = max(want[0], 1e-300)
    assert np.abs(squares - want).max() <= 1e-13 * size
    kept = squares > 1e-12 * size
    z = vectors[:, kept]
    assert np.abs(z.T @ z - np.eye(kept.sum())).max(initial=0) < 1e-9
    assert np.abs(a.T @ (a @ z) - z * squares[kept]).max(initial=0) <= 1e-13 * size


def test_small_singular_values_keep_their_digits():
    a = np.triu(np.random.default_rng(2).uniform(1, 2, size=(20, 20)))
    diagonal, upper, _ = bidiagonal.bidiagonalise(a)
    diagonal = diagonal * 10.0 ** -np.arange(20)
    upper = upper * 10.0 ** -np.arange(19)
    found = sorted(bidiagonal.dqds(diagonal, upper), reverse=True)
    # The product of the squares is the squared determinant, whatever their sizes.
    assert math.isclose(math.fsum(map(math.log, found)), 2 * math.fsum(math.log(abs(d)) for d in diagonal), rel_tol=1e-12)


def test_digest_of_the_codebooks(spark):
    from jobledger.llm import queries

    rows = queries.op12_vector_codes(spark, "/root/testdata/sf0.001").collect()
    found = vector_codes.compress(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert {r["codebooks_sha256"] for r in rows} == {hashlib.sha256(",".join(map(str, found.codebooks.ravel())).encode()).hexdigest()}
