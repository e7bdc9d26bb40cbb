import heapq
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firegrid.llm import packing, sharding, tokens
from firegrid.session import scratch_path
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, encode):
    docs = cases.with_repeats(spark)
    got = tokens.token_digests(tokens.round_trip(spark, docs.repartition(7), PATH, 2, "<u2")).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = encode(t) + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_words_share_their_cores(encode, monkeypatch):
    monkeypatch.setattr(tokens, "WORD_CACHE", 20)
    monkeypatch.setattr(tokens, "LOT_BYTES", 200)
    own = tokens.WordEncoder(PATH, "<u4")
    assert own.folds and {*".,;:!?"} <= {*own.tail} and own.parted and {*"azéößñÉÖ"} <= {*own.letters}
    alphabet = ["a", "B", "é", "İ", "J\u030c", "e\u0301", "7", ".", ",", "!", "'s", "'", "-", " ", "\n", "\u00a0", "\x1c", "Σ", "漢", "<|endoftext|>", "<|", "<|startoftext|>", "x<y", "|>", "$%", "**", "_"]
    r = random.Random(2)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    for at in range(0, len(texts), 50):
        ids, sizes = own(pa.array(texts[at : at + 50] + [None, ""]), 9)
        want = [encode(t) + [9] for t in texts[at : at + 50] + ["", ""]]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    own.parted = own.parter = None  # every word by itself gives the same
    own._forget()
    ids, _ = own(pa.array(texts[:100]), 9)
    assert ids.tolist() == [i for t in texts[:100] for i in [*encode(t), 9]]
    assert own(pa.array([], pa.string()), 9)[0].tolist() == []


def test_token_files_by_part(spark, encode):
    docs, folder = cases.table(spark), scratch_path(spark, "tokens")
    index = tokens.write_token_files(docs, folder, PATH, 2).orderBy("part").collect()
    local = folder.removeprefix("file:")
    flat = np.concatenate([np.fromfile(f"{local}/tokens-{r.part:06d}-{r.attempt}.bin", "<u4") for r in index])
    starts = np.concatenate([np.fromfile(f"{local}/{r.offsets}", "<i8") for r in index])
    ids = [encode(t) + [2] for _, t in cases.texts()]
    assert sum(ids, []) == flat.tolist()
    assert starts.tolist() == np.cumsum([0] + [len(x) for x in ids[:-1]]).tolist()
    assert not [f for f in os.listdir(local) if f.endswith(".part")]
    assert tokens.round_trip(spark, cases.table(spark, []), PATH, 2, "<u2").collect() == []


def test_rows_of_one_id_are_spread(spark, encode):
    rows = [(None, f"text {i % 50} of no id") for i in range(400)] + [(7, f"again {i}") for i in range(100)]
    docs, folder = cases.table(spark, rows), scratch_path(spark, "tokens")
    index = tokens.write_token_files(docs, folder, PATH, 2, rows=160_000)  # as of a larger table: more parts
    assert index.where("n_docs > 0").count() > 2
    got = tokens.token_digests(tokens.read_token_files(index, folder)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i or -1, len(encode(t)) + 1, crc(encode(t) + [2])) for i, t in rows
    )
    assert sorted(r.start for r in got) == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(room) if x >= n]
        i = min(fits, key=lambda i: room[i]) if fits else len(room)
        if not fits:
            room.append(capacity)
        room[i] -= n
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_best_fit_plan(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in packing.best_fit(counts, capacity):
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_pack_documents(spark, encode):
    docs = cases.with_repeats(spark)
    got = packing.pack_documents(docs.repartition(6), PATH, 0, 64).collect()
    pieces = defaultdict(list)
    for r in got:
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and r.length == len(r.ids) // 4
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for row in docs.collect():
        ids = encode(row.text) + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            want[row.doc_id].append((k, at, len(ids[at : at + 64]), crc(ids[at : at + 64])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for spans in full.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(full) == plain_best_fit([r.length for r in got], 64)
    assert packing.pack_documents(cases.table(spark, []), PATH).collect() == []


def plain_lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, s))
    return sorted(x for x, _ in heap)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9) | st.integers(1, 400), max_size=150), st.integers(1, 9))
def test_schedule(sizes, shards):
    histogram = sorted(((n, sizes.count(n)) for n in set(sizes)), reverse=True)
    loads, ranks = [0] * shards, defaultdict(list)
    for size, shard, low, high in sharding.schedule(histogram, shards):
        loads[shard] += size * (high - low)
        ranks[size] += range(low, high)
    assert sorted(loads) == plain_lpt(sizes, shards)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram}


def test_shard_by_bytes(spark):
    docs = cases.with_repeats(spark)
    got = sharding.shard_by_bytes(docs.repartition(6), 3).collect()
    rows = docs.collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows
    )
    homes, slots, loads, groups = defaultdict(set), defaultdict(list), defaultdict(int), defaultdict(int)
    for r in got:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.text_crc32] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.values()) == plain_lpt(groups.values(), 3)
    assert sharding.shard_by_bytes(cases.table(spark, [])).collect() == []
