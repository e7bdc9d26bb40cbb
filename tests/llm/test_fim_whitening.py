import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from firegrid.llm import fim, whitening
from firegrid.llm.fim import BoundarySet, Container, boundaries
from tests.llm import cases

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_form(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_containers_select_every_rank():
    r = np.random.default_rng(3)
    sets = {
        "array": np.unique(r.integers(0, 1 << 16, 900)),
        "bitmap": np.unique(r.integers(0, 1 << 16, 30_000)),
        "run": np.concatenate([np.arange(10, 4000), np.arange(5000, 5001), np.arange(60_000, 65_536)]),
    }
    for kind, low in sets.items():
        c = Container(low)
        assert c.kind == kind
        assert [c.select(i) for i in range(len(low))] == low.tolist()


def test_boundary_set_over_many_containers():
    r = np.random.default_rng(4)
    parts = [np.unique(r.integers(0, 1 << 16, 500)), np.arange(7 << 16, (7 << 16) + 9000), (9 << 16) + np.unique(r.integers(0, 1 << 16, 20_000))]
    positions = np.concatenate(parts).astype(np.uint32)
    found = BoundarySet(positions)
    assert {c.kind for c in found.containers} == {"array", "run", "bitmap"}
    some = r.integers(0, len(positions), 3000).tolist() + [0, len(positions) - 1]
    assert [found.select(i) for i in some] == positions[some].tolist()
    with pytest.raises(IndexError):
        found.select(len(positions))
    assert len(BoundarySet(np.zeros(0, np.uint32))) == 0


def test_boundaries_are_token_ends():
    r = random.Random(5)
    for text in ["", " ", "a", " a", "a ", "\x1c \x85", *("".join(r.choice(" \n\tabä\U0001f600 ") for _ in range(40)) for _ in range(200))]:
        ends = [0]
        for m in TOKEN.finditer(text):
            ends.append(m.end())
        assert boundaries(text).tolist() == ends


def test_fim_matches_brute_force_and_restores(spark):
    long = cases.words(40_000, 11) + " 漢字 " + " " * 70_000 + "end "
    rows = cases.texts() + [(i, cases.words(30, i) + "\n tail  ") for i in range(30, 90)]
    rows += [(100, "has <P> inside"), (101, "almost <P"), (102, "M> <S P> <<P"), (103, long), (104, long), (None, "no id"), (None, None), (5, "again")]
    docs = cases.table(spark, rows)
    got = fim.transform(docs)
    want = [(i, *brute_form(i, t)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [(i, n, f, a, b, sha(o), sha(t or "")) for (i, t), (_, n, f, a, b, o) in zip(rows, want)]
    assert sorted(map(tuple, fim.digests(got).collect()), key=str) == sorted(digests, key=str)
    assert fim.transform(cases.table(spark, [])).collect() == []


# Whitening ------------------------------------------------------------------------------------------

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()),
     T.StructField("n", T.StringType()), T.StructField("component", T.StringType())]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("size", [1, 2, 5, 33])
def test_eigenvectors_by_division(size):
    r = np.random.default_rng(size)
    for x in (r.standard_normal((200, size)), r.standard_normal((200, size)) * np.logspace(3, -3, size), np.repeat(r.standard_normal((50, 1)), size, 1)):
        a = np.cov(x.T, bias=True).reshape(size, size)
        values, q = whitening.eigenvectors(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-12 * values[0])
        assert np.abs(q.T @ q - np.eye(size)).max() < 1e-13
        assert np.linalg.norm(a @ q - q * values) < 1e-12 * np.linalg.norm(a)


def test_eigenvectors_of_equal_and_zero_values():
    values, q = whitening.eigenvectors(np.diag([1.0, 3, 3, 1, 3]))
    assert values.tolist() == pytest.approx([3, 3, 3, 1, 1])
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-14
    assert whitening.eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    u = whitening.polar_factor(np.diag([5.0, -1e-9, 2.0]))
    assert np.allclose(u, np.diag([1, -1, 1]))


def test_whitening_matches_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((300, 6)) @ np.diag([4, 2, 1, 0.5, 0.2, 0.1]) + 3
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(None, rows[3][1]), (5, rows[5][1])]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0, 2.0]), (2005, [])]
    got = whitening.whiten(vectors(spark, rows + bad), components=4).collect()
    x = np.array([[math.floor(256 * float(np.float32(v))) for v in row] for _, row in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    assert len(got) == 4 * len(rows)
    signs = {}
    want = {}
    for (i, _), row in zip(rows, x):
        for k in range(4):
            w = float((row - sums / n) @ q[:, k] / math.sqrt(values[k]))
            want.setdefault((i, k + 1), []).append((int(((n * row - sums) ** 2).sum()), w))
    for g in got:
        some = want[g.vec_id, g.component]
        assert g.n == n and g.deviation in [d for d, _ in some]
        assert g.explained == pytest.approx(values[g.component - 1] / values.sum(), rel=1e-10)
        assert 0 <= g.identity_error < 1e-9
        w = min((w for _, w in some), key=lambda w: abs(abs(w) - abs(g.whitened)))
        assert abs(g.whitened) == pytest.approx(abs(w), rel=1e-8, abs=1e-9)
        if abs(w) > 1e-6:
            signs.setdefault(g.component, set()).add(math.copysign(1, w * g.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_poor_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 4.0])])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(one)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in one} == {1.0} and {round(r.explained, 9) for r in one} == {1.0}
    far = whitening.whiten(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e30, 0.0])])).collect()
    assert {r.vec_id for r in far} == {1, 2} and {r.deviation for r in far} == {None}


def test_deviations_are_exact():
    def exact(x, n, sums):
        whole = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return [v if v < 1 << 63 else None for v in whole]

    for x, n, sums in [([[1 << 30, -5], [-7, 7]], 3, [10, 20]), ([[123456, 765432]], 1000, [5, 6]), ([[1 << 40, 0], [3, 0]], 2, [1, 1])]:
        assert whitening.deviations(np.array(x), n, sums) == exact(x, n, sums)
    assert None in exact([[1 << 40, 0]], 2, [1, 1])
