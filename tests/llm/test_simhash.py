import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from firegrid.llm import simhash
from firegrid.llm.graph import components
from firegrid.llm.shared import documents
from tests.llm import cases


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def check(rows, got, radius=3):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, radius)
    want = sorted((str(i), f"{f:016x}", str(rows[r][0])) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_awkward_rows(spark):
    docs = cases.with_repeats(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs.repartition(5)).collect())
    assert simhash.near_duplicates(cases.table(spark, [])).collect() == []


def test_whole_table_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("run", [simhash.RUN, 40])
def test_dense_cluster_split_into_chunks(spark, run):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = r.choice(sorted(fps)) if r.random() < 0.5 else r.getrandbits(64)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    for n in (len(fps), 10**6, 10**12):  # other sizes choose other partitions
        search = simhash.plan_search(simhash.bit_counts(nodes), n, 3)
        assert sum(t + 1 for t in search.allowed) == 4 and sorted(sum(search.parts, ())) == list(range(64))
        made = components(simhash.links(nodes, search, 3, len(fps), run)).collect()
        label = {x.node & (2**64 - 1): x.label & (2**64 - 1) for x in made}
        roots = brute_components(fps, 3)
        groups = {}
        for f, root in zip(fps, roots):
            groups.setdefault(root, set()).add(f)
        for members in groups.values():
            assert len({label.get(f, f) for f in members}) == 1
        assert len({label.get(f, f) for f in fps}) == len(groups)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 5))
def test_link_run(fps, radius):
    flipped = sorted({f ^ (1 << i % 64) for i, f in enumerate(fps)} | set(fps))
    a, b = simhash.link_run(np.array(flipped, np.uint64), radius)
    assert (np.bitwise_count(a ^ b) <= radius).all()
    parent = {f: f for f in flipped}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    want = brute_components(flipped, radius)
    assert len({root(f) for f in flipped}) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 200), (59, 61)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in (*range(7, 60), 61))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
