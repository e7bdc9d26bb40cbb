import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from firegrid.llm import toxicity as X
from tests.llm import cases

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
PLAIN = "the weather over the river was mild and the boats went out early to fish near the islands while people walked home".split()


def planted(n=400, seed=1):
    """Half of the rows hold a nasty word, a third of those in disguise."""
    r = random.Random(seed)
    disguises = {"vermin": ["v3rm1n", "v e r m i n", "veeermin", "vermin"], "dimwit": ["d1mw1t", "dimmmwit", "d.i.m.w.i.t", "dimwit"]}
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(40)]
        toxic = i % 2
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(40), r.choice(disguises[r.choice(list(disguises))]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def characters(spark):
    return X.character_model(cases.table(spark, planted()[0]))


def test_gram_counts_match_a_loop():
    for text in ["", "Ab  c.d", "  x1y\n\nÄß 漢 z ", "a" * 50]:
        want = Counter()
        state, classes = (X.GAP, X.GAP), X.class_of()
        for c in (" " + text.lower() + " ")[1:]:
            k = int(classes[ord(c)])
            if k == X.GAP and state[1] == X.GAP:
                continue
            want[(state[0] * X.CLASSES + state[1]) * X.CLASSES + k] += 1
            state = (X.GAP if k == X.GAP else state[1], k)
        got = X.gram_counts(text)
        got = {int(i): int(got[i]) for i in np.flatnonzero(got)}
        got.pop(0, None)  # a gap after nothing
        want.pop(0, None)
        assert got == dict(want)


def test_counts_cover_all_texts(spark):
    docs = cases.with_repeats(spark)
    total = sum(X.gram_counts(r.text or "") for r in docs.collect())
    one = X.CharacterModel.of_counts(total)
    # Texts in one piece share their gaps with their neighbours; only the count of gaps after nothing differs.
    assert np.allclose(X.character_model(docs).logs[2:], one.logs[2:], atol=1e-5)
    empty = X.character_model(cases.table(spark, []))
    assert np.isfinite(empty.logs).all()


def test_viterbi_is_exact(characters):
    def brute(places, end):
        best = None
        for path in itertools.product(*places):
            state, total = (X.GAP, X.GAP), sum(p for _, p in path)
            for c in "".join(t for t, _ in path) + (" " if end else ""):
                p, state = characters.step(state, int(X.class_of()[ord(c)]))
                total += p
            if best is None or total > best[0] + 1e-9:
                best = total, "".join(t for t, _ in path)
        return best

    for token in ["d1mw1t", "v3rm1n", "w34ther", "booooats", "1s1and5", "r!ver", "2024", "a|||b"]:
        places = X.token_lattice(token)
        text, _ = X.viterbi(places, characters, (X.GAP, X.GAP), True)
        assert text == brute(places, True)[1]
    places = X.spaced_lattice("r i v e r")
    assert X.viterbi(places, characters, (X.GAP, X.GAP), True)[0] == brute(places, True)[1]


def test_restored_texts(characters):
    own = X.Restorer(characters)
    assert own("The R1VER was m1ld")[0] == "the river was mild"
    assert own("b o a t s went ouuuut")[0] == "boats went out"
    assert own("weather over the river") == ("weather over the river", 0)
    assert own("") == ("", 0)
    long = "w34th3r" * 3000
    assert len(own(long)[0]) == len(long)
    assert own("a" * 100_000)[0] in ("a", "aa")


def test_scores_of_planted_texts(spark):
    rows, labels = planted()
    odd = [(None, None), (None, "vermin here"), (900, ""), (901, None), (3, rows[3][1]), (902, "v 3 r m 1 n")]
    docs = cases.table(spark, rows + odd)
    known = spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (7, 1, 0)], LABELS)
    model = X.learn(docs, known)
    got = X.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 400}
    right = sum(by_id[i].predicted == t for i, _, t in labels)
    assert right >= 0.98 * len(labels)
    held = [i for i, _, _ in labels if by_id[i].held_out]
    assert 40 < len(held) < 140 and all(by_id[i].predicted == i % 2 for i in held)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    special = {r.doc_id: r.predicted for r in got if r.doc_id in (900, 901, 902)}
    assert special == {900: 0, 901: 0, 902: 1}
    assert X.score(cases.table(spark, []), model).collect() == []


def test_held_out_labels_are_not_learned(spark):
    rows, labels = planted()
    docs = cases.table(spark, rows)
    frame = spark.createDataFrame(labels, LABELS)
    held = {r[0] for r in frame.where(X.held_out(frame.doc_id)).select("doc_id").collect()}
    turned = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], LABELS)
    a, b = X.learn(docs, frame), X.learn(docs, turned)
    assert a.grams == b.grams and np.allclose(a.weights, b.weights)


def test_learning_without_labels(spark):
    docs = cases.with_repeats(spark)
    none = spark.createDataFrame([], LABELS)
    rows = X.score(docs, X.learn(docs, none)).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} == {0}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(25)], LABELS)
    assert {r.predicted for r in X.score(docs, X.learn(docs, one_kind)).collect()} == {0}
