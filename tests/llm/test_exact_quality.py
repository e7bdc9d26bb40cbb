import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from firegrid.llm import quality
from firegrid.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm import cases

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def expected_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    docs = cases.with_repeats(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    digest = F.substring(F.unhex(F.sha2("norm", 256)), 1, 0) if weak else None
    got = exact_dedup(docs.repartition(5), digest=digest, salts=3)
    assert sorted(map(tuple, got.collect()), key=str) == expected_dedup(rows)


def test_exact_dedup_empty_and_drop(spark):
    assert exact_dedup(cases.table(spark, [])).collect() == []
    docs = cases.with_repeats(spark)
    stay = drop_copies(docs, exact_dedup(docs))
    assert stay.columns == docs.columns
    norms = [(r.text or "").translate(LOWER) for r in stay.collect()]
    assert len(norms) == len(set(norms)) == len({(r.text or "").translate(LOWER) for r in docs.collect()})


def brute_measures(text):
    words = [w for w in __import__("re").split("[ \t\n\r\x0b\x0c]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_measures_and_policies(spark):
    docs = cases.with_repeats(spark)
    table = quality.verdicts(quality.ledger(docs), "web-1").collect()
    assert len(table) == docs.count()
    by_id = dict(cases.texts()) | {None: "text of no id", 21: None}
    for r in table:
        want = brute_measures(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in table if r.kept}
    assert {4, 9, 10, 19, 20} <= kept and not kept & {1, 2, 3, 8, 11, 12, 15, 17}


def test_ablations_count_bits(spark):
    ledger = quality.ledger(cases.table(spark)).cache()
    rows = ledger.collect()
    own = quality.mask("web-1")
    for r in quality.ablations(ledger, "web-1").collect():
        bit = next(1 << x.bit for x in quality.rules() if x.name == r.rule)
        assert r.fails == sum(bool(x.failures & bit) for x in rows)
        assert r.fails_alone == sum(x.failures & own == bit for x in rows)
        assert r.kept_if_alone == sum(not x.failures & bit for x in rows)
    assert quality.ledger(cases.table(spark, [])).collect() == []
