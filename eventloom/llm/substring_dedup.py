"""Repeated word windows by super-k-mers.

Consecutive windows of a document that share a minimiser, the least hash among their runs of
`SEED_WORDS` words, form a super-k-mer. It travels as one string, packed with those of its chunk
that go to the same bucket. Equal windows have equal minimisers and so meet in one bucket,
where windows are sorted by a hash and neighbours compared by content. All but the first of
equal windows are marked, and the marks are joined to the documents by row.

Of equal super-k-mers in a chunk only the first is sent; the others are marked at once. A
passage of any number of copies reaches a bucket once per chunk.

Sizes of buckets are known before any text travels. The windows of a bucket over the limit are dealt out
to other buckets by their minimiser under another hash, and those of a bucket that is over the
limit even then one by one, by a hash of the whole window. Equal windows take the same way, and
all that must meet in one bucket in the end is the first of a window's copies in each chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import rolling
from eventloom.llm.common import arrow_limits, keyed, narrow, slices, text_bytes, write_table

WORDS = 20
SEED_WORDS = 4
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
MOST_WINDOWS = 64
# A bucket of more bytes than so many times its share is dealt out again.
CROWDED = 4

_SENT = "bucket int, data binary, no_ids binary, keys binary, starts binary, windows binary"
_MARKS = "no_id boolean, key bigint, first int, windows int"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words(NamedTuple):
    """Words joined by one space, their places in that text, and the row of each."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.append(word[1:], False)
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    lengths = ends - starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    placed = np.cumsum(lengths + 1) - (lengths + 1)
    # A mask for where word bytes go: a byte each, where numbers of places would take 24.
    inner = np.ones(int(lengths.sum()) + len(lengths), bool)
    inner[placed + lengths] = False
    text = np.full(len(inner), 0x20, np.uint8)
    text[inner] = data[word]
    return Words(text, placed, placed + lengths, rows)


def _minimisers(words: Words, k: int, seed: int) -> np.ndarray:
    """Of each window, also of those that reach into the next row."""
    size = min(SEED_WORDS, k)
    single = rolling.mixed(rolling.range_hashes(words.text, words.starts, words.ends), seed)
    seeds = np.zeros(len(single) - size + 1, np.uint64)
    for i in range(size):
        seeds = rolling.mixed(seeds + single[i : i + len(seeds)], i)
    return rolling.sliding_min(seeds, k - size + 1)


def super_kmers(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each; a window is named by its first word."""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _minimisers(words, k, seed)
    inside = words.rows[:n] == words.rows[k - 1 :]
    change = np.append(True, least[1:] != least[:-1])
    first, windows = rolling.split_runs(*rolling.runs(inside, change), MOST_WINDOWS)
    return first, windows, least[first]


def routed(words: Words, k: int, buckets: int, crowded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, bucket) of what is sent as one string.

    `crowded` has the buckets that are too large of each round. Those of the first round have
    numbers below `buckets`, those of the second below twice as many, and so on.
    """
    first, windows, least = super_kmers(words, k)
    bucket = (least % np.uint64(buckets)).astype(np.int64)
    for seed, large in enumerate(crowded, 1):
        again = np.isin(bucket, large)
        if not again.any():
            break
        count = windows[again]
        run = np.repeat(np.arange(len(count)), count)
        own = np.repeat(first[again], count) + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        before = bucket[again][run].astype(np.uint64)
        if seed == 1:
            value = _minimisers(words, k, seed)[own]
            breaks = np.append(True, (np.diff(value) != 0) | (np.diff(run) != 0))
        else:
            singles = rolling.mixed(rolling.range_hashes(words.text, words.starts, words.ends), seed)
            value = rolling.range_hashes(singles, own, own + k)
            breaks = np.ones(len(own), bool)
        at, length = rolling.runs(np.ones(len(own), bool), breaks)
        target = seed * buckets + (rolling.mixed(value + before, seed)[at] % np.uint64(buckets)).astype(np.int64)
        first, windows = np.concatenate((first[~again], own[at])), np.concatenate((windows[~again], length))
        bucket = np.concatenate((bucket[~again], target))
        # In the order of the text, so that of equal strings the first is sent.
        order = np.argsort(first, kind="stable")
        first, windows, bucket = first[order], windows[order], bucket[order]
    return first, windows, bucket


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows in the order of (no_id, key)."""
    return batch.take(pa.array(np.lexsort((_column(batch, "key"), _column(batch, "no_id")))))


def _pack(values: np.ndarray) -> bytes:
    """Increasing sequences differ by little, which packs better than the values."""
    return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), kind), dtype=kind)


def _sizes(k: int, buckets: int, crowded: list[np.ndarray]):
    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes that a chunk sends to each bucket of the last round, without its copies."""
        for batch in slices(batches, "text", CHUNK_BYTES):
            words = words_of(*raw_texts(batch.column("text")))
            first, windows, bucket = routed(words, k, buckets, crowded)
            last = bucket >= len(crowded) * buckets
            first, windows, bucket = first[last], windows[last], bucket[last]
            if not len(first):
                continue
            begin, end = words.starts[first], words.ends[first + windows + k - 2]
            _, different = np.unique(rolling.range_hashes(words.text, begin, end), return_index=True)
            found, at = np.unique(bucket[different], return_inverse=True)
            total = np.bincount(at, (end - begin)[different] + 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(total)], names=["bucket", "bytes"]
            )

    return sizes


def crowded_buckets(docs: DataFrame, k: int, buckets: int, limit: int) -> list[np.ndarray]:
    """Per round the buckets over `limit` bytes; the driver gets one number for each."""
    crowded: list[np.ndarray] = []
    while len(crowded) < 2:
        sizes = docs.select("text").mapInArrow(_sizes(k, buckets, crowded), "bucket int, bytes bigint")
        large = sizes.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > limit)
        found = np.array(sorted(r["bucket"] for r in large.collect()), np.int64)
        if not len(found):
            break
        crowded.append(found)
    return crowded


def _send(k: int, buckets: int, crowded: list[np.ndarray]):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            batch = in_order(batch)
            words = words_of(*raw_texts(batch.column("text")))
            first, windows, buckets_of = routed(words, k, buckets, crowded)
            if not len(first):
                continue
            no_id, key = _column(batch, "no_id"), _column(batch, "key")
            rows = words.rows[first]
            head = np.searchsorted(words.rows, rows, "left")
            place = (first - head).astype(np.int32)
            text = words.text.tobytes()
            at = words.starts[first].tolist()
            upto = words.ends[first + windows + k - 2].tolist()
            parts = [text[a:b] for a, b in zip(at, upto, strict=True)]
            seen: dict[bytes, int] = {}
            same = np.fromiter((seen.setdefault(p, i) for i, p in enumerate(parts)), np.int64, len(parts))
            copy = same != np.arange(len(parts))
            # A repeated row stands at the same place as its first one, which marks nothing.
            later = copy & ~((key[rows] == key[rows[same]]) & (no_id[rows] == no_id[rows[same]]) & (place == place[same]))
            out: list[tuple] = []
            marks = np.flatnonzero(later)
            if len(marks):
                out.append((int(buckets_of[0]), None, marks))
            sent = np.flatnonzero(~copy)
            bucket = buckets_of[sent]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for group in np.split(order, cuts):
                own = sent[group]
                data = b"\n".join([parts[i] for i in own.tolist()])
                out.append((int(bucket[group[0]]), zstandard.compress(data, 3), own))
            columns = [
                pa.array([b for b, _, _ in out], pa.int32()),
                pa.array([d for _, d, _ in out], pa.binary()),
                *(
                    pa.array([_pack(v[i]) for _, _, i in out], pa.binary())
                    for v in (no_id[rows].astype(np.int8), key[rows], place, windows.astype(np.int32))
                ),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "data", "no_ids", "keys", "starts", "windows"])

    return send


class Group(NamedTuple):
    """Super-k-mers that are searched together: their text and where they stand."""

    text: bytes
    no_ids: np.ndarray
    keys: np.ndarray
    starts: np.ndarray


def _marked(group: Group, k: int, seed: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(no_id, key, first, windows) of windows that start earlier elsewhere in the group."""
    if len(group.text) > 4 * BUCKET_BYTES and seed < 8:
        yield from _dealt(group, k, seed + 1)
        return
    data = np.frombuffer(group.text, np.uint8)
    lines = np.append(0, np.flatnonzero(data == 0x0A) + 1)
    words = words_of(data, np.append(lines, len(data)))
    n = len(words.starts) - k + 1
    windows = np.flatnonzero(words.rows[:n] == words.rows[k - 1 :])
    if not len(windows):
        return
    line = words.rows[windows]
    head = np.searchsorted(words.rows, np.arange(len(lines)), "left")
    place = group.starts[line] + (windows - head[line])
    singles = rolling.mixed(rolling.range_hashes(words.text, words.starts, words.ends))
    hashes = rolling.mixed(rolling.range_hashes(singles, windows, windows + k))
    order = np.lexsort((place, group.keys[line], group.no_ids[line], hashes))
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), np.int64)
    first[order] = leader
    begin, end = words.starts[windows], words.ends[windows + k - 1]
    twice = np.flatnonzero(first != np.arange(len(windows)))
    if not _equal(words.text, begin, end, first, twice, windows):
        seen: dict[bytes, int] = {}
        text = words.text.tobytes()
        by_place = np.lexsort((place, group.keys[line], group.no_ids[line]))
        for i in by_place.tolist():
            first[i] = seen.setdefault(text[begin[i] : end[i]], i)
    moved = (
        (group.keys[line] != group.keys[line[first]])
        | (group.no_ids[line] != group.no_ids[line[first]])
        | (place != place[first])
    )
    breaks = np.append(True, (np.diff(windows) != 1) | (np.diff(line) != 0))
    at, length = rolling.runs(moved, breaks)
    yield group.no_ids[line[at]], group.keys[line[at]], place[at], length


def _equal(text, begin, end, first, twice, windows) -> bool:
    """Whether windows have the content of their first ones.

    Where the window before was compared with the one before its first, only the last byte range
    that is new has to be.
    """
    a, b = begin[twice], begin[first[twice]]
    length = end[twice] - a
    if (length != end[first[twice]] - b).any():
        return False
    follows = np.zeros(len(twice), bool)
    follows[1:] = (
        (np.diff(twice) == 1)
        & (np.diff(windows[twice]) == 1)
        & (np.diff(first[twice]) == 1)
        & (np.diff(windows[first[twice]]) == 1)
        & (a[1:] < end[twice][:-1])
    )
    known = np.zeros(len(twice), np.int64)
    known[1:] = np.where(follows[1:], end[twice][:-1] - a[1:], 0)
    return rolling.same_ranges(text, a + known, b + known, length - known)


def _dealt(group: Group, k: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for a large group, which is dealt out by minimisers of another hash."""
    data = np.frombuffer(group.text, np.uint8)
    lines = np.append(0, np.flatnonzero(data == 0x0A) + 1)
    words = words_of(data, np.append(lines, len(data)))
    first, windows, least = super_kmers(words, k, seed)
    head = np.searchsorted(words.rows, np.arange(len(lines)), "left")
    row = words.rows[first]
    parts = -(-len(group.text) // BUCKET_BYTES)
    target = (least % np.uint64(parts)).astype(np.int64)
    text = words.text.tobytes()
    begin, end = words.starts[first], words.ends[first + windows + k - 2]
    place = group.starts[row] + (first - head[row])
    del words
    for part in range(parts):
        own = np.flatnonzero(target == part)
        if len(own):
            joined = b"\n".join([text[begin[i] : end[i]] for i in own.tolist()])
            last = seed + (len(joined) > len(group.text) // 2) * 8
            yield from _marked(Group(joined, group.no_ids[row[own]], group.keys[row[own]], place[own]), k, last)


def _search(k: int):
    def answer(found: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for no_ids, keys, first, windows in found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.asarray(no_ids).astype(bool)), pa.array(keys, pa.int64()),
                    pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)),
                ],
                names=["no_id", "key", "first", "windows"],
            )

    def whole(rows: list[tuple]) -> Group:
        return Group(
            b"\n".join([zstandard.decompress(r[0]) for r in rows]),
            *(np.concatenate([r[i] for r in rows]) for i in (1, 2, 3)),
        )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                places = (
                    _unpack(row["no_ids"], np.int8), _unpack(row["keys"], np.int64),
                    _unpack(row["starts"], np.int32),
                )
                if row["data"] is None:
                    yield from answer([(*places, _unpack(row["windows"], np.int32))])
                    continue
                if row["bucket"] != bucket and rows:
                    yield from answer(_marked(whole(rows), k))
                    rows = []
                bucket = row["bucket"]
                rows.append((row["data"], *places))
        if rows:
            yield from answer(_marked(whole(rows), k))

    return search


def sent_strings(docs: DataFrame, k: int = WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What `keyed` documents send to buckets of about `bucket_bytes`."""
    arrow_limits(docs.sparkSession)
    # A window takes part in about 2 / (k - SEED_WORDS + 2) super-k-mers' k - 1 extra words.
    growth = 1 + 2 * (k - 1) / (k - SEED_WORDS + 2)
    buckets = max(1, int(text_bytes(docs) * growth / bucket_bytes))
    crowded = crowded_buckets(docs, k, buckets, CROWDED * bucket_bytes)
    return docs.select("no_id", "key", "text").mapInArrow(_send(k, buckets, crowded), _SENT)


def marks(docs: DataFrame, k: int = WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(no_id, key, first, windows): runs of windows of `keyed` documents that start earlier elsewhere."""
    sent = sent_strings(docs, k, bucket_bytes)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(k), _MARKS)


def _kept(k: int):
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed = [], [], []
            for text, spans in zip(
                batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True
            ):
                found = text.split()
                gone = np.zeros(len(found) + 1, np.int64)
                for span in spans or ():
                    # Rows that share an id may be shorter than the one the span is from.
                    gone[min(span["first"], len(found))] += 1
                    gone[min(span["first"] + span["windows"] + k - 1, len(found))] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                texts.append(b" ".join([found[i] for i in keep]))
                words.append(len(found))
                removed.append(len(found) - len(keep))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return kept


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    A word is removed if a window of `k` words covers it whose words also start earlier, in a
    document of smaller id or earlier in the same one. Null texts have no words. Documents
    without an id come after all others, in the order of a hash of their text. Rows that share an id are one place:
    repeated rows keep what the first keeps, and if their texts differ, what is marked in one is
    removed from each. Other columns are not read, and an empty table gives an empty result.
    """
    rows = keyed(narrow(docs, doc_id, text))
    found = write_table(marks(rows, k), "marks")
    spans = found.groupBy("no_id", "key").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    return (
        rows.join(spans, ["no_id", "key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_kept(k), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
    )
