import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.llm import suffix_dedup as sd
from firegrid.llm.shared import documents
from tests.llm import cases


def brute(rows):
    """``rows`` (id, text) of distinct ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - sd.LENGTH + 1):
            window = raw[p : p + sd.LENGTH]
            if window in seen:
                gone[p : p + sd.LENGTH] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.count_nonzero(gone[1:] < gone[:-1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed_rows():
    r = random.Random(11)
    passages = [cases.words(n, 100 + n) for n in (12, 20, 25, 40, 60, 300)]
    rows = list(cases.texts())
    for i in range(60):
        parts = [cases.words(r.randrange(1, 60), 1000 + i)]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            cut = r.randrange(len(p) // 3 + 1)
            parts += [p[cut : cut + r.randrange(20, len(p) + 20)], cases.words(r.randrange(6), 2000 + i)]
        if r.random() < 0.2:
            parts.append(r.choice(["é", "ab", "xyz漢"]) * r.randrange(1, 400))
        r.shuffle(parts)
        rows.append((1000 + r.randrange(10**6), " ".join(parts)))
    near = list(cases.words(200, 77))
    for i in range(25):
        copy = near.copy()
        copy[r.randrange(len(copy))] = "#"
        rows.append((5000 + i, "".join(copy)))
    return list(dict(rows).items())


@pytest.fixture(params=["whole", "small"])
def limits(request, monkeypatch):
    if request.param == "small":  # every boundary is met: segments, runs, turns of one anchor, local batches
        for name, value in (("BUFFER", 700), ("RUN", 9), ("PIECE", 2500), ("LOCAL", 3000)):
            monkeypatch.setattr(sd, name, value)
    return request.param


def in_one_process(rows):
    """The task code on one machine, so that changed limits hold."""
    rows = [(i if i is not None else sd.LAST, t or "") for i, t in rows]
    rows.sort()
    found = []
    for buf, text, place in sd.buffers([t.encode() for _, t in rows]):
        h, anchors = sd.window_anchors(buf, place)
        assert set(anchors[anchors > 0].tolist()) == set(h[sd.anchor_positions(h, anchors)].tolist())
        for s, n in zip(*(x.tolist() for x in sd.runs(anchors))):
            key = (int(anchors[s]), rows[text[s]][0], 0)
            found.append(sd.Stretch(key, int(place[s]), n, buf[s : s + n - 1 + sd.LENGTH].tobytes()))
    found.sort(key=lambda s: (s.key, s.start))
    gone = {}
    for s in sd.resolve_sorted(iter(found)):
        for w in np.flatnonzero(s.again if s.again is not None else []).tolist():
            gone.setdefault(s.key[1], []).append((s.start + w, 1))
    out = []
    for i, t in rows:
        raw, spans = t.encode(), sd.merged(gone.get(i, []))
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
        out.append((i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_task_code_against_brute_force(limits):
    rows = mixed_rows()
    assert in_one_process(rows) == brute(rows)


def test_one_anchor_in_many_turns(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1500)
    base = cases.words(40, 3)
    rows = [(i, base[: 60 + i % 37] + chr(97 + i % 5) + base[60 + i % 37 :]) for i in range(200)]
    assert in_one_process(rows) == brute(rows)


def test_mixed_rows(spark):
    rows = mixed_rows() + [(None, cases.words(200, 77))]
    got = sd.digests(sd.remove_repeats(cases.table(spark, rows).repartition(7))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    got = sd.digests(sd.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_and_empty_rows(spark):
    docs = cases.with_repeats(spark)
    got = sd.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    twice = [(r.n_removed, bytes(r.kept)) for r in got if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0][0] == 0
    assert sd.remove_repeats(cases.table(spark, [])).collect() == []


def test_names_keep_the_order_of_prefixes():
    r = random.Random(5)
    text = bytes(r.choice(b"ab") for _ in range(3000))
    places = np.arange(len(text) - sd.LENGTH + 1)
    later = {int(x) for _, l in sd.repeats(text, places) for x in l}
    seen, want = set(), set()
    for p in places.tolist():
        want |= {p} if text[p : p + sd.LENGTH] in seen else set()
        seen.add(text[p : p + sd.LENGTH])
    assert later == want


def hot_rows():
    """A common line in different surroundings, some of them shared, and a long passage with different edges."""
    r = random.Random(4)
    line, passage = "this very common line of more than 32 bytes", cases.words(60, 9)
    rows = [(i, f"{cases.words(30, 9000 + i)} {line} {cases.words(30, 9500 + i)}") for i in range(120)]
    rows += [(200 + i, f"{cases.words(20, i % 7)} {line} {cases.words(20, i % 5)}") for i in range(40)]
    rows += [(300 + i, f"{cases.words(9, 800 + i)} {passage} {cases.words(9, 900 + i)}") for i in range(40)]
    rows.append((400, " ".join(f"{line} {r.randrange(99)}" for _ in range(60))))
    return rows


def test_hot_anchors_are_split(spark, monkeypatch):
    rows = hot_rows()
    met = []
    dealt = sd.repeated_starts
    monkeypatch.setattr(sd, "repeated_starts", lambda found, tasks: met.append(found) or dealt(found, tasks))
    for hot in (sd.HOT, 20):
        got = sd.digests(sd.remove_repeats(cases.table(spark, rows).repartition(3), hot=hot)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows), hot
    # The largest number of different stretches that have one key, and so meet in one task.
    most = [f.groupBy("anchor").agg(F.countDistinct("bytes").alias("n")).agg(F.max("n")).first()[0] for f in met]
    assert most[0] > 30 and most[1] <= 20


def test_rows_without_id_are_dealt_by_their_texts(spark, monkeypatch):
    shared = cases.words(40, 9)
    docs = cases.table(spark, [(i if i % 3 else None, f"{cases.words(30, 600 + i)} {shared}") for i in range(90)])
    seen = []
    real = sd.stretches
    monkeypatch.setattr(sd, "stretches", lambda texts, *rest: seen.append(texts) or real(texts, *rest))
    got = sd.remove_repeats(docs).collect()
    # Of the 30 rows without an id none is first, and each loses the shared passage.
    assert len(got) == 90 and all(r.n_removed >= len(shared) for r in got if r.doc_id is None)
    assert sum(r.n_removed < len(shared) for r in got) == 1
    # What texts are dealt by tells them apart.
    assert seen[0].where("doc_id IS NULL").select("key").distinct().count() >= 29
    assert seen[0].groupBy("key").count().where("count > 1").isEmpty()
