import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from firegrid.llm import byte_bpe, language, warc
from firegrid.llm.shared import SharedFiles, documents, safe_pieces
from firegrid.session import scratch_path
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_round_trip(spark, plain):
    docs = cases.with_repeats(spark)
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN))
    want = []
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    empty = byte_bpe.encode(cases.table(spark, []), RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.decode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_safe_pieces_keep_the_ids(plain):
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "Zé", "漢", "7", ".", "'s", "'", " ", "  ", "\n", "\t", "\r\n", " ", "\x1d"]) for _ in range(300))
        pieces = list(safe_pieces(text, 20))
        assert "".join(pieces) == text and len(pieces) > 3
        assert sum((plain.encode_ordinary(p) for p in pieces), []) == plain.encode_ordinary(text)


def test_raw_bytes_of_single_ids(spark, plain):
    rows = [(i, np.array([plain.encode_single_token(bytes([b]))], "<u4").tobytes()) for i, b in enumerate((0xC3, 0xFF, 0x80))]
    got = byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), RANKS, public_tokenizers.PATTERN).collect()
    assert {bytes(r.decoded) for r in got} == {b"\xc3", b"\xff", b"\x80"}


def brute_grams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {w} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip() and " " not in g[1:-1])
    return out


def test_gram_counts_against_brute_force():
    for _, text in cases.texts():
        grams, n = language.gram_counts(text or "")
        name = lambda g: "".join(chr(c) for k in range(3) if (c := g >> 21 * k & (1 << 21) - 1))
        assert {name(g): c for g, c in zip(grams.tolist(), n.tolist())} == brute_grams(text or "")


def test_pieces_of_long_texts(monkeypatch):
    text = cases.words(500, 3) + " élève Übung"
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(language.gram_counts(text), whole))


def test_out_of_place_distance():
    key = lambda s: sum(ord(c) << 21 * k for k, c in enumerate(s))
    profiles = language.Profiles(["aa", "bb"], np.array(sorted([key("a"), key("b"), key(" a")])), np.zeros((2, 3), np.int64) - 1)
    where = {g: i for i, g in enumerate(profiles.grams.tolist())}
    profiles.ranks[0, where[key("a")]], profiles.ranks[0, where[key(" a")]], profiles.ranks[1, where[key("b")]] = 0, 2, 0
    # "a" gives the n-grams a, " a", "a ", " a " in the order of their numbers.
    lang, score = language.predict_text("a", profiles, size=10)
    order = sorted(["a", " a", "a ", " a "], key=key)
    cost = sum({"a": abs(0 - order.index("a")), " a": abs(2 - order.index(" a"))}.get(g, 10) for g in order)
    assert lang == "aa" and score == pytest.approx(1 - cost / 40)


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    profiles = language.learn(language.training_rows(docs))
    rows = language.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    docs = cases.with_repeats(spark)
    profiles = language.learn(language.training_rows(docs, sample=1000))
    got = {r.doc_id: r for r in language.identify(docs, profiles).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 8, 21}
    nothing = language.learn(language.training_rows(cases.table(spark, [])))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(cases.table(spark, []), profiles).collect() == []


PAGES = [
    (5, "http://a.example/ü?q=1\n2", "<p>x</p>"),
    (3, None, "<p>x</p>"),
    (9, "http://b.example", "<p>x</p>"),
    (4, "http://c.example", None),
    (6, "http://c.example", ""),
    (7, "u", "WARC/1.1 \r\n\r\n" + "näive 漢 " * 5000),
    (8, "u", "".join(random.Random(4).choices("abcdefgh<>\n", k=200_000))),
    (None, "u", "<p>x</p>"),
    (None, "u", "alone"),
    (11, "u", "twice"),
    (11, "u", "twice"),
    (12, "u", "twice"),
]


def expected_pages():
    out = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(same) if i is not None and min(same) < i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if first is not None else "response", first))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [97, 5000, warc.SPLIT])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, first_id string, sha int")
    got = warc.page_records(warc.round_trip(spark, pages.repartition(3), split=split)).collect()
    assert sorted(map(tuple, got), key=str) == expected_pages()
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_archives_are_gzip_members_with_payloads(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(warc.with_originals(pages.repartition(2)), folder)
    files = SharedFiles(folder)
    n = 0
    for a in archives.collect():
        with files.open(a.file) as f:
            data = f.read()
        assert len(data) == a.bytes
        n += gzip.decompress(data).count(b"WARC-Record-ID: ") if data else 0
    assert n == len(PAGES)
    payloads = {(r.record_id, bytes(r.payload)) for r in warc.read_archives(archives, folder).where("record_type = 'response'").collect()}
    assert ("<urn:page:8>", PAGES[6][2].encode()) in payloads


def test_false_heads_are_passed_over(tmp_path):
    noise = warc.MAGIC + b"no member" + gzip.compress(b"not a record") + warc.MAGIC
    good = gzip.compress(warc.record(1, None, b"abc", None))
    path = tmp_path / "x.gz"
    path.write_bytes(noise + good + noise)
    with open(path, "rb") as f:
        assert [(at, warc.parse(c)["payload"]) for at, c in warc.members(f, 0, 10**6)] == [(len(noise), b"abc")]
        assert list(warc.members(f, len(noise) + 1, 10**6)) == []
