"""Removal of byte strings that also start earlier, by difference-cover suffix sorting.

Equal strings of ``LENGTH`` bytes have the same anchor: the smallest hash among the ``GRAM``-byte
strings inside. Anchors that occur once in the corpus are left out, the rest deal the stretches of
text around them to tasks. There the suffixes are sorted by difference cover: the triples at two of
three positions are sorted and named, the names are tripled in turn until they stand for the whole
prefix, the remaining positions are merged in by the shift that takes a pair to sampled positions,
and neighbours with equal prefixes are repeats. Names are exact, hashes only deal out work.

An anchor that occurs more than ``HOT`` times (a frequent phrase, the edge of a passage) would bring all
the different stretches around it to one task. Its windows are dealt one by one instead, by a hash of
the whole window, and only those whose hash occurs more than once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.llm.shared import batch_of, in_batches, store, texts_of

LENGTH = 100
GRAM = 32
#: Bytes whose hashes are held at once, windows of one stretch, bytes of stretches that are sorted at once.
BUFFER, RUN, PIECE = 1 << 19, 256, 1 << 20
#: Text of a batch within which equal stretches are put together before the shuffle.
LOCAL = 8 << 20
#: Corpus bytes per bucket of anchors and per partition of texts.
BUCKET_BYTES, TEXT_BYTES = 16 << 20, 64 << 20
#: Occurrences from which an anchor's windows are dealt one by one; windows of such anchors a task remembers.
HOT, WINDOWS = 20_000, 200_000
LAST = (1 << 63) - 1

SLICES = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("hashes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
REPEATED = pa.schema([("key", pa.int64()), ("hash", pa.int64())])
STRETCHES = pa.schema(
    [("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
)
STARTS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
        ("kept_text", pa.string()),
    ]
)


# Anchors --------------------------------------------------------------------------------------------


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash (never 0) of each ``GRAM``-byte string, built by doubling; GRAM is a power of two."""
    h, base, k = buf.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while k < GRAM:
        h = h[:-k] * np.uint64(base) + h[k:]
        base, k = base * base & (1 << 64) - 1, 2 * k
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values in a row, by doubling."""
    k = 1
    while 2 * k <= width:
        values, k = pick(values[:-k], values[k:]), 2 * k
    return pick(values[: len(values) - (width - k)], values[width - k :]) if k < width else values


def buffers(raws: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in buffers of about ``BUFFER`` bytes: (bytes, index of the text, place in it) per byte.

    Long texts are cut into segments that overlap so that each window lies whole in just one.
    """
    held, size = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(len(raw) - LENGTH + 1, 0), BUFFER):
            part = raw[at : at + BUFFER + LENGTH - 1]
            held.append((part, i, at))
            size += len(part)
            if size >= BUFFER:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.array([len(p) for p, _, _ in held])
    firsts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(p for p, _, _ in held), np.uint8)
    text = np.repeat(np.array([i for _, i, _ in held]), sizes)
    place = np.arange(len(buf)) - np.repeat(firsts - np.array([at for _, _, at in held]), sizes)
    last = np.repeat(firsts + sizes - LENGTH, sizes)  # the last window of the segment
    return buf, text, np.where(np.arange(len(buf)) <= last, place, -1)


def window_anchors(buf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, anchor of each window; 0 where a window would leave its segment)."""
    h = gram_hashes(buf)
    least = sliding(h, LENGTH - GRAM + 1, np.minimum)
    return h, np.where(place[: len(least)] >= 0, least, np.uint64(0))


def anchor_positions(h: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Grams that are the anchor of a window: those whose hash is the largest anchor around them."""
    none = np.zeros(LENGTH - GRAM, np.uint64)
    most = sliding(np.concatenate([none, anchors, none]), LENGTH - GRAM + 1, np.maximum)
    return np.flatnonzero(most == h)


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each whole window, from the hashes of the grams that cover it."""
    n = len(h) - (LENGTH - GRAM)
    out = np.zeros(max(n, 0), np.uint64)
    for at in [*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
        out = (out ^ h[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, windows) of the stretches of windows with one anchor, at most ``RUN`` windows each."""
    change = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    first = np.flatnonzero(change)
    sizes = np.diff(np.concatenate([first, [len(anchors)]]))
    first, sizes = first[anchors[first] > 0], sizes[anchors[first] > 0]
    pieces = -(-sizes // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(first, pieces) + nth * RUN
    return starts, np.minimum(np.repeat(first + sizes, pieces) - starts, RUN)


def anchors_of(raws: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the anchors, index of their text) for each buffer."""
    for buf, text, place in buffers(raws):
        h, anchors = window_anchors(buf, place)
        at = anchor_positions(h, anchors)
        yield h[at], text[at]


def windows_of(hot: np.ndarray):
    """As ``anchors_of``, for the windows of the anchors ``hot``."""

    def pick(raws: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for buf, text, place in buffers(raws):
            h, anchors = window_anchors(buf, place)
            at = np.flatnonzero(np.isin(anchors, hot))
            yield window_hashes(h)[at], text[at]

    return pick


def repeated_hashes(texts: DataFrame, buckets: int, pick=anchors_of, hot: int = LAST) -> DataFrame:
    """(key, hash) of the hashes of ``pick`` that occur more than once in ``texts`` (key, text).

    A hash that occurs more than ``hot`` times is also put out with a null ``key``. Hashes travel
    packed. Of a hash that a batch has more than once only one goes on, with its count, and its
    documents are known already; a hash that a third of all texts have thus meets once per batch.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for some, text in pick(t.encode() for t in texts_of(batch)):
                hashes.append(some)
                docs.append(ids[text])
            hashes, docs = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
            n = np.diff(np.concatenate([first, [len(hashes)]]))
            many = np.repeat(n > 1, n)
            rows = {k: [] for k in SLICES.names}

            def put(bucket, known, some, owners, counts):
                for name, value in zip(SLICES.names, (bucket, known, some.tobytes(), owners.tobytes(), counts.tobytes())):
                    rows[name].append(value)

            if many.any():
                put(int(hashes[0] % np.uint64(buckets)), True, hashes[many], docs[many], np.zeros(0, np.int32))
            one, owner, n = hashes[first], docs[first], n.astype(np.int32)
            home = (one % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                if len(part):
                    put(int(home[part[0]]), False, one[part], owner[part], n[part])
            yield batch_of(SLICES, rows)

    def meet(table: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        met = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for row in table.to_pylist():
            hashes, docs = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["docs"], np.int64)
            if row["known"]:
                found.append((docs, hashes))
            else:
                met.append((hashes, docs, np.frombuffer(row["counts"], np.int32)))
        hashes, docs, counts = (np.concatenate(x) for x in zip(*met))
        order = np.argsort(hashes, kind="stable")
        hashes, docs, counts = hashes[order], docs[order], counts[order]
        same = np.concatenate([hashes[1:] == hashes[:-1], [False]])[: len(hashes)]
        again = (same | np.concatenate([[False], same[:-1]])[: len(hashes)]) & (counts == 1)
        found.append((docs[again], hashes[again]))
        doc, hash_ = (np.concatenate(x) for x in zip(*found))
        first = np.flatnonzero(np.concatenate([[True], ~same[:-1]])[: len(hashes)])
        many = hashes[first][np.add.reduceat(counts.astype(np.int64), first) > hot] if len(first) else hashes
        out = pa.table({"key": doc, "hash": hash_.view(np.int64)}, schema=REPEATED)
        frequent = {"key": pa.nulls(len(many), pa.int64()), "hash": many.view(np.int64)}
        return pa.concat_tables([out, pa.table(frequent, schema=REPEATED)])

    slices = texts.select("key", "text").mapInArrow(find, "bucket long, known boolean, hashes binary, docs binary, counts binary")
    return slices.groupBy("bucket").applyInArrow(meet, "key long, hash long").distinct()


# Suffix sorting -------------------------------------------------------------------------------------


def names_of(*keys: np.ndarray) -> np.ndarray:
    """Names in the order of the tuples of ``keys``: equal tuples have equal names."""
    packed = keys[0].astype(np.uint64)
    for k in keys[1:]:
        packed = packed << np.uint64(int(k.max(initial=0)).bit_length()) | k.astype(np.uint64)
    return np.unique(packed, return_inverse=True)[1]


def repeats(buf: bytes, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (first, later) among ``places`` (ascending) of ``buf`` where equal strings of LENGTH bytes start.

    Sampled are the places that 3 does not divide. Sampled tuples of 8 bytes are sorted and named; the
    names of three tuples a multiple of 3 apart are sorted and named in turn, until a name stands for
    LENGTH - 2 bytes, less what is appended as bytes. Two places of any kind are both sampled after a
    shift of 0, 1 or 2, so for each shift the places it fits are sorted by (bytes before, name, bytes
    after) and neighbours compared.
    """
    text = np.frombuffer(buf + bytes(3 * LENGTH), np.uint8)
    sampled = np.arange(1, len(buf) + LENGTH)
    sampled = sampled[sampled % 3 != 0]
    words = np.zeros(len(sampled), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | text[sampled + k]
    names, span = names_of(words), 8

    def after(names: np.ndarray, shift: int) -> np.ndarray:
        """Names ``shift`` places on: two samples for every three places."""
        step = shift // 3 * 2
        return np.concatenate([names[step:], np.zeros(step, names.dtype)])

    while LENGTH - 2 - span > 2:
        step = min(span, LENGTH - 2 - span) // 3 * 3
        second = min(2 * step, (LENGTH - 2 - span) // 3 * 3)
        names = names_of(names, after(names, step), after(names, second))
        span += second
    tail = LENGTH - 2 - span
    out = []
    for shift in range(3):
        own = places[(places + shift) % 3 != 0]
        at = own + shift
        key = [text[own + k] for k in range(shift)] + [names[at // 3 * 2 + at % 3 - 1]]
        key += [text[at + span + k] for k in range(tail + 2 - shift)]
        name = names_of(*key)
        order = np.argsort(name, kind="stable")
        name, own = name[order], own[order]
        first = np.concatenate([[True], name[1:] != name[:-1]])[: len(name)]
        out.append((own[np.maximum.accumulate(np.where(first, np.arange(len(name)), 0))][~first], own[~first]))
    return out


class Stretch:
    """A stretch of text: ``n`` windows from ``start`` on, and which of them start earlier too."""

    __slots__ = ("key", "start", "n", "bytes", "again")

    def __init__(self, key, start, n, data):
        self.key, self.start, self.n, self.bytes, self.again = key, start, n, data, None

    def mark(self, window: int | slice) -> None:
        if self.again is None:
            self.again = np.zeros(self.n, bool)
        self.again[window] = True

    def same_place(self, other: Stretch) -> bool:
        return self.key == other.key and self.start == other.start


def resolve(stretches: list[Stretch], alone: bool) -> None:
    """Mark the windows of ``stretches`` (of whole anchors, each in order) that also start before.

    Equal stretches need no sorting, nor does an anchor with one distinct stretch unless that repeats
    within itself. ``alone``: all stretches have one anchor.
    """
    distinct: dict[bytes, Stretch] = {}
    for s in stretches:
        first = distinct.setdefault(s.bytes, s)
        if first is not s and not first.same_place(s):
            s.mark(slice(None))
    left = list(distinct.values())
    if not alone:
        n: dict[tuple, int] = {}
        for s in left:
            n[s.key[0]] = n.get(s.key[0], 0) + 1
        left = [s for s in left if n[s.key[0]] > 1 or len({s.bytes[k : k + LENGTH] for k in range(s.n)}) < s.n]
    if not left:
        return
    sizes = np.array([len(s.bytes) for s in left])
    firsts = np.cumsum(sizes) - sizes
    windows = np.array([s.n for s in left])
    owner = np.repeat(np.arange(len(left)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = firsts[owner] + inside
    for first, later in repeats(b"".join(s.bytes for s in left), places):
        if not len(later):
            continue
        a, b = np.searchsorted(firsts, first, "right") - 1, np.searchsorted(firsts, later, "right") - 1
        for i, w, j, v in zip(b.tolist(), (later - firsts[b]).tolist(), a.tolist(), (first - firsts[a]).tolist()):
            if not (left[i].key == left[j].key and left[i].start + w == left[j].start + v):
                left[i].mark(w)


def resolve_sorted(rows: Iterator[Stretch]) -> Iterator[Stretch]:
    """Stretches sorted by anchor and place, back with their repeats marked; bounded for anchors of any size.

    An anchor with more stretches than fit is taken in turns: what has a window of its own stays, in
    pieces of bounded size, and each later turn is held against every piece.
    """
    held: list[Stretch] = []
    size = 0
    pieces: list[list[Stretch]] = []  # of the anchor that ``held`` begins with

    def turn(some: list[Stretch], last: bool) -> None:
        for piece in pieces or [[]]:
            resolve(piece + some, bool(piece))
        if last:
            pieces.clear()
            return
        stay = [s for s in some if s.again is None or not s.again.all()]
        if pieces and sum(len(s.bytes) for s in pieces[-1] + stay) < PIECE // 2:
            pieces[-1] += stay
        elif stay:
            pieces.append(stay)

    for s in rows:
        if size >= PIECE:
            anchor = held[-1].key[0]
            if held[0].key[0] != anchor:
                cut = next(i for i, x in enumerate(held) if x.key[0] == anchor)
                if pieces:  # the first anchor ends here
                    end = next(i for i, x in enumerate(held) if x.key[0] != held[0].key[0])
                    turn(held[:end], True)
                    yield from held[:end]
                    held, cut = held[end:], cut - end
                turn(held[:cut], True)
                yield from held[:cut]
                held = held[cut:]
            else:
                turn(held, False)
                yield from held
                held = []
            size = sum(len(x.bytes) for x in held)
        if pieces and held and held[0].key[0] != s.key[0] and held[-1].key[0] == held[0].key[0]:
            turn(held, True)
            yield from held
            held, size = [], 0
        if pieces and not held and pieces[0][0].key[0] != s.key[0]:
            pieces.clear()
        held.append(s)
        size += len(s.bytes)
    if held:
        turn(held, True)
        yield from held


# The jobs -------------------------------------------------------------------------------------------


def stretches(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Stretches around the repeated anchors of ``texts`` (doc_id, doc, tie, text, hashes, windows).

    A stretch that a batch has had goes on without its bytes: all its windows start earlier. Other
    stretches of the anchors ``hot`` go on as single windows, those whose hash is among ``windows``;
    windows in a row that the batch has had are one stretch without bytes again.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            wanted = np.unique(column["hashes"].flatten().to_numpy().view(np.uint64))
            doc, tie = column["doc"].to_pylist(), column["tie"].to_pylist()
            order = sorted(range(len(doc)), key=lambda i: (doc[i], tie[i]))
            texts = texts_of(batch)
            repeated = np.unique(column["windows"].flatten().to_numpy().view(np.uint64))
            seen: dict[bytes, tuple] = {}
            seen_windows: dict[bytes, tuple] = {}
            done, rows = 0, {n: [] for n in STRETCHES.names}

            def put(*row):
                for name, value in zip(STRETCHES.names, row):
                    rows[name].append(value)

            def spread(doc, start):
                return ((doc ^ start) * 0x9E3779B97F4A7C15 + start) % (1 << 63)

            def put_windows(data, hashes, chosen, where):
                """The ``chosen`` windows of a stretch at ``where`` whose bytes are ``data``."""
                d, t, p = where
                known: list[list[int]] = []  # start and number of windows that the batch has had
                for w in chosen:
                    own, place = data[w : w + LENGTH], (d, t, p + w)
                    first = seen_windows.setdefault(own, place)
                    if first == place:
                        put(hashes[w], *place, 1, own)
                    elif known and sum(known[-1]) == p + w:
                        known[-1][1] += 1
                    else:
                        known.append([p + w, 1])
                for start, n in known:
                    put(spread(d, start), d, t, start, n, None)
                if len(seen_windows) > WINDOWS:
                    seen_windows.clear()

            for buf, text, place in buffers(texts[i].encode() for i in order):
                h, anchors = window_anchors(buf, place)
                starts, n = runs(anchors)
                chosen = np.isin(anchors[starts], wanted)
                starts, n = starts[chosen], n[chosen]
                data, anchor = buf.tobytes(), anchors[starts].view(np.int64).tolist()
                frequent = np.isin(anchors[starts], hot)
                if frequent.any():
                    whole = window_hashes(h)
                    shared = np.isin(whole, repeated)
                    whole = whole.view(np.int64)
                places = zip(anchor, text[starts].tolist(), starts.tolist(), place[starts].tolist(), n.tolist(), frequent.tolist())
                for a, i, s, p, k, one_by_one in places:
                    own, where = data[s : s + k - 1 + LENGTH], (doc[order[i]], tie[order[i]], p)
                    first = seen.setdefault(own, where)
                    if first != where:
                        put(spread(where[0], p), *where, k, None)
                    elif one_by_one:
                        put_windows(own, whole[s : s + k].tolist(), np.flatnonzero(shared[s : s + k]).tolist(), where)
                    else:
                        put(a, *where, k, own)
                done += len(buf)
                if done > LOCAL:
                    seen, done = {}, 0
                yield batch_of(STRETCHES, rows)
                rows = {n: [] for n in STRETCHES.names}

    return texts.mapInArrow(task, "anchor long, doc long, tie long, start long, n long, bytes binary")


def repeated_starts(found: DataFrame, tasks: int) -> DataFrame:
    """(doc, tie, start, n): n windows in a row from ``start`` on whose bytes also start earlier."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {n: [] for n in STARTS.names}

        def put(*row):
            for name, value in zip(STARTS.names, row):
                out[name].append(value)

        def rows():
            for batch in batches:
                for anchor, doc, tie, start, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if data is None:
                        put(doc, tie, start, n)
                    else:
                        yield Stretch((anchor, doc, tie), start, n, data)

        for s in resolve_sorted(rows()):
            if s.again is not None:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], s.again, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    put(s.key[1], s.key[2], s.start + a, b - a)
            if len(out["doc"]) > 50_000:
                yield batch_of(STARTS, out)
                out = {n: [] for n in STARTS.names}
        yield batch_of(STARTS, out)

    dealt = found.repartition(tasks, "anchor").sortWithinPartitions("anchor", "doc", "tie", "start")
    return dealt.mapInArrow(task, "doc long, tie long, start long, n long")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered runs of the windows (start, n)."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(ranges):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (start, end of removed runs), kept (bytes),
    kept_text (the same without what is left of characters cut in two), row (the columns ``carry``).

    A byte goes where a string of ``LENGTH`` bytes covers it that also starts earlier: in a document
    of smaller id, or before in the same one. Strings are judged on the input. Null text counts as
    empty; shorter texts stay whole. Rows without an id come last, rows of one id in the order of
    their texts' hashes; rows equal in both are one document, each with the same result. An empty
    table gives no rows, further columns are ignored.

    Texts are dealt by document once, for the stretches and again for the removal: by a hash of id and
    text, so that rows without an id, or of one id, spread; ranges are matched by both. Anchors that occur
    more than ``hot`` times cost one more reading of the texts; results do not depend on ``hot``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = in_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in carry)).alias("row"),
    ).withColumn("key", F.xxhash64("doc", "tie"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = max(partitions, size // BUCKET_BYTES), max(partitions, size // TEXT_BYTES)
    anchors = store(repeated_hashes(own, buckets, hot=hot), "anchors")
    frequent = np.array([r[0] for r in anchors.where("key IS NULL").select("hash").collect()], np.int64).view(np.uint64)
    found = anchors.where("key IS NOT NULL").select("key", "hash", F.lit(None).cast("long").alias("window"))
    if len(frequent):
        windows = repeated_hashes(own, buckets, windows_of(frequent))
        found = found.unionByName(windows.select("key", F.lit(None).cast("long").alias("hash"), F.col("hash").alias("window")))
    again = found.groupBy("key").agg(F.collect_list("hash").alias("hashes"), F.collect_list("window").alias("windows"))
    dealt = own.repartition(tasks, "key")
    starts = repeated_starts(stretches(dealt.join(again, "key"), frequent), buckets)
    starts = starts.withColumn("key", F.xxhash64("doc", "tie"))
    by_key = starts.groupBy("key").agg(F.collect_list(F.struct("doc", "tie", "start", "n")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "row"}
            rows = {n: [] for n in CUT.names}
            for doc_id, doc, tie, content, ranges in zip(*(column[n] for n in ("doc_id", "doc", "tie", "text", "ranges"))):
                raw = content.encode()
                spans = merged([(r["start"], r["n"]) for r in ranges or () if (r["doc"], r["tie"]) == (doc, tie)])
                ends = [0, *(b for _, b in spans)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)]))
                values = (doc_id, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans], kept, kept.decode("utf-8", "ignore"))
                for name, value in zip(CUT.names, values):
                    rows[name].append(value)
            row = batch.column(batch.schema.get_field_index("row"))
            yield batch_of(CUT, rows).append_column("row", row)

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in CUT.names[:3]])
    schema = schema.add("spans", spans).add("kept", T.BinaryType()).add("kept_text", T.StringType()).add(own.schema["row"])
    return dealt.join(by_key, "key", "left").mapInArrow(cut, schema)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
