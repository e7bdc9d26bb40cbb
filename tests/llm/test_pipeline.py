from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from firegrid.llm import suffix_dedup as sd
from firegrid.llm.shared import documents
from tests.llm import cases
from tests.llm.test_exact_quality import LOWER, brute_measures
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokens_packing_shards import crc, plain_best_fit


def passes(text):
    n, chars, symbols, dup, repeated = brute_measures(text)
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
    bad = n < 10 or 100 * repeated > 20 * n or symbols * 10 > n or dup * 10 > 3 * lines
    return not (bad or chars < 3 * n or chars > 12 * n)


def brute_pieces(rows, tokenizer):
    rows = {i: t for i, t in sorted(rows) if passes(t)}
    last = {t.translate(LOWER): i for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if last[t.translate(LOWER)] == i}
    roots = brute_components([brute_fingerprint(t) for t in rows.values()], 3)
    rows = {i: t for k, (i, t) in enumerate(rows.items()) if roots[k] == k}
    seen, out = set(), []
    for i, t in rows.items():
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - sd.LENGTH + 1):
            window = raw[p : p + sd.LENGTH]
            if window in seen:
                gone[p : p + sd.LENGTH] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        ids = tokenizer.encode(kept, add_special_tokens=False).ids + [0]
        out += [(i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    return sorted(out)


def check(spark, docs, got):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = brute_pieces([(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 for s in full.values())
    assert all([a for a, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1]] for s in full.values())
    assert len(full) == plain_best_fit([r[3] for r in want], 2048)


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    check(spark, documents(spark, sf), corpus_pipeline.run(spark, sf).collect())


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, t) for i, t in cases.texts()] + [(100 + i, cases.words(90, 50 + i // 2)) for i in range(6)]
    docs = cases.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    assert len(corpus_pipeline.STAGES) == 5
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, out, "").write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.dtypes == docs.dtypes
            assert out.where("lang != 'en'").isEmpty()
    check(spark, docs, out.collect())


def test_empty_table(spark, tmp_path):
    out = cases.table(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, "").write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
    assert out.isEmpty()


def test_rows_without_id_and_shared_ids_keep_their_texts(spark, tmp_path):
    """Verdicts belong to (id, text): clean different texts stay, copies go, one row for each component."""
    a, b, c, d, f, g = (cases.words(90, 200 + k) for k in range(6))
    rows = [(None, a), (None, b), (None, b.upper()), (None, c), (7, c), (8, d), (8, a), (9, d), (8, f), (8, g), (8, g)]
    docs = cases.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    exact = corpus_pipeline.drop_exact_copies(spark, docs.repartition(5), "")
    # a: id 8 over none; b: no id, once (the least of its spellings); c: 7 over none; d: 9 over 8; f and g: both of id 8.
    want = [(8, a), (None, min(b, b.upper())), (7, c), (9, d), (8, f), (8, g)]
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == sorted(want, key=str)

    path = str(tmp_path / "exact")
    exact.write.parquet(path)
    stored = spark.read.parquet(path)
    apart = corpus_pipeline.drop_near_copies(spark, stored, "")
    assert sorted(((r.doc_id, r.text) for r in apart.collect()), key=str) == sorted(want, key=str)


def test_one_row_for_each_component_whatever_the_ids(spark):
    fps = {}
    for k in range(4000):
        text = cases.words(90, 7000 + k // 40) + f" z{k}"
        fps[text] = brute_fingerprint(text)
    base = next(t for t in fps)
    close = next(t for t in fps if t != base and bin((fps[t] ^ fps[base]) & (1 << 64) - 1).count("1") <= 3)
    other, third = cases.words(90, 301), cases.words(90, 302)
    rows = [(None, base), (None, close), (None, other), (None, other), (5, third), (5, cases.words(90, 303))]
    docs = cases.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "").collect()]
    assert len(got) == 4 and len(set(got)) == 4
    assert {(None, other), (5, third), (5, cases.words(90, 303))} < set(got)
    assert sum(t in (base, close) for _, t in got) == 1


def test_cutting_keeps_every_column(spark):
    docs = cases.with_repeats(spark)
    got = corpus_pipeline.cut_repeats(spark, docs, "")
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {(r.digest, r.norm, r.shard, r.kept, r.lang) for r in got.collect()} == {("x", 7, "s", False, "en")}
    assert all(r.n_chars == len(r.text) for r in got.collect())
    narrow = corpus_pipeline.cut_repeats(spark, docs.select("text", "doc_id"), "")
    assert narrow.columns == ["text", "doc_id"]
    assert sorted(map(tuple, narrow.collect()), key=str) == sorted(((r.text, r.doc_id) for r in got.collect()), key=str)
