"""Repeated byte strings by suffix sorting.

A suffix array of everything cannot be sorted in one place. Windows of `LENGTH` bytes are dealt
out so that equal ones meet: consecutive windows that share an anchor, the least hash among
their runs of `ANCHOR` bytes, form a piece, and pieces go to a bucket by anchor. An anchor that occurs only once
in the corpus holds no repeated window, so only places of anchors are shuffled at first, and then the
pieces whose anchor repeats. Inside a bucket, the pieces' suffixes are sorted in two stages and
neighbours with `LENGTH` bytes in common are marked.

Equal pieces in a chunk are marked at once and the first of them is passed on, so a passage of
any number of copies reaches a bucket once per chunk.

Bytes per anchor are known before any piece travels. Pieces of an anchor over the limit are cut by a
second hash, and again only those travel whose pair of anchors repeats. Windows that share both anchors,
where these are over the limit too, are told apart by 128-bit digests, one row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import rolling
from eventloom.llm.common import arrow_limits, keyed, narrow, slices, text_bytes, write_table
from eventloom.llm.suffixes import repeated

LENGTH = 400
ANCHOR = 128
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
MOST_WINDOWS = 2048
# An anchor whose pieces have more bytes than so many buckets should is not sent to one.
CROWDED = 4
DIGEST_BYTES = 16
DIGESTED_WINDOWS = 1 << 16

_PLACES = "anchor bigint, weight int, no_id boolean, key bigint, first int, windows int"
_DIGESTS = "digest binary, no_id boolean, key bigint, first int, several boolean"
_SENT = "bucket int, data binary, no_ids binary, keys binary, firsts binary, windows binary"
_MARKS = "no_id boolean, key bigint, first int, windows int"


class Pieces(NamedTuple):
    """Per piece: its row, first window in the data, number of windows, anchor, and 2 if the anchor moves."""

    rows: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchors: np.ndarray
    weights: np.ndarray


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = 0) -> Pieces:
    """Pieces of all rows data[offsets[i]:offsets[i + 1]]."""
    size = max(1, min(ANCHOR, length // 2))
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return Pieces(none, none, none, none.astype(np.uint64), none)
    at = np.arange(len(data) - size + 1)
    hashes = rolling.mixed(rolling.range_hashes(data, at, at + size), seed)
    mask = np.uint64((1 << max(8, int(len(data)).bit_length())) - 1)
    # The place in the low bits makes the first of equal hashes the least.
    least = rolling.sliding_min((hashes & ~mask) | at.astype(np.uint64), length - size + 1)
    where = (least & mask).astype(np.int64)
    anchors = hashes[where]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.arange(n) + length <= ends
    change = np.append(True, anchors[1:] != anchors[:-1])
    first, windows = rolling.split_runs(*rolling.runs(inside, change), MOST_WINDOWS)
    rows = np.searchsorted(offsets, first, "right") - 1
    weights = np.where(where[first] == where[first + windows - 1], 1, 2)
    return Pieces(rows, first, windows, anchors[first], weights)


def raw_segments(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(data, offsets, row of each segment, its place in the row); a very long row makes several."""
    column = batch.column("text").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if len(data) <= 2 * CHUNK_BYTES:
        yield data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for row in range(len(offsets) - 1):
        own = data[offsets[row] : offsets[row + 1]]
        for base in range(0, len(own), CHUNK_BYTES):
            part = own[base : base + CHUNK_BYTES + length - 1]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([base])


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _same_place(no_id, key, first, a, b) -> np.ndarray:
    return (no_id[a] == no_id[b]) & (key[a] == key[b]) & (first[a] == first[b])


def _copies(parts: list[bytes], no_id: np.ndarray, key: np.ndarray, first: np.ndarray):
    """(first of equal parts for each, whether its part stands at several places)."""
    seen: dict[bytes, int] = {}
    same = np.fromiter((seen.setdefault(p, i) for i, p in enumerate(parts)), np.int64, len(parts))
    # A repeated row stands at the same place as its first one.
    moved = ~_same_place(no_id, key, first, np.arange(len(parts)), same)
    several = np.zeros(len(parts), bool)
    several[same[moved]] = True
    return same, several[same]


def _passed(text: bytes, found: Pieces, anchors, no_id, key, first, length: int) -> pa.RecordBatch:
    """Pieces that repeat in a chunk, without an anchor, and the first of equal ones with its anchor."""
    upto = found.first + found.windows + length - 1
    parts = [text[a:b] for a, b in zip(found.first.tolist(), upto.tolist(), strict=True)]
    same, several = _copies(parts, no_id, key, first)
    marked = np.flatnonzero(several)
    passed = np.flatnonzero(same == np.arange(len(same)))
    weight = np.where(several[passed], 2, found.weights[passed])
    both = np.concatenate((marked, passed))
    known = np.arange(len(both)) < len(marked)
    anchor = np.concatenate((np.zeros(len(marked), np.int64), anchors[passed].view(np.int64)))
    weights = np.concatenate((np.zeros(len(marked), np.int32), weight.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor, mask=known), pa.array(weights, mask=known), pa.array(no_id[both]),
            pa.array(key[both], pa.int64()), pa.array(first[both].astype(np.int32)),
            pa.array(found.windows[both].astype(np.int32)),
        ],
        names=["anchor", "weight", "no_id", "key", "first", "windows"],
    )


def _find(length: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            for data, offsets, rows, bases in raw_segments(batch, length):
                found = pieces(data, offsets, length)
                if not len(found.first):
                    continue
                no_id, key = _values(batch, "no_id")[rows[found.rows]], _values(batch, "key")[rows[found.rows]]
                first = found.first - offsets[found.rows] + bases[found.rows]
                yield _passed(data.tobytes(), found, found.anchors, no_id, key, first, length)

    return find


def _wanted(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(piece, anchor, no_id, key, first) of the places of each row."""
    rows = zip(
        batch.column("no_id").to_pylist(), batch.column("key").to_pylist(),
        batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), strict=True,
    )
    for no_id, key, text, places in rows:
        for p in places:
            piece = text[p["first"] : p["first"] + p["windows"] + length - 1]
            # Rows that share an id may be shorter than the one the place is from.
            if len(piece) == p["windows"] + length - 1:
                yield piece, p["anchor"], no_id, key, p["first"]


def _in_chunks(items: Iterator[tuple], limit: int, size) -> Iterator[list[tuple]]:
    chunk, total = [], 0
    for item in items:
        chunk.append(item)
        total += size(item)
        if total >= limit:
            yield chunk
            chunk, total = [], 0
    if chunk:
        yield chunk


def _find_again(length: int):
    def cut(chunk: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join([x[0] for x in chunk]), np.uint8)
        offsets = np.append(0, np.cumsum([len(x[0]) for x in chunk]))
        found = pieces(data, offsets, length, 1)
        anchor = np.array([x[1] for x in chunk], np.int64).view(np.uint64)[found.rows]
        anchors = rolling.mixed(found.anchors + anchor, 1)
        no_id = np.array([x[2] for x in chunk], bool)[found.rows]
        key = np.array([x[3] for x in chunk], np.int64)[found.rows]
        first = np.array([x[4] for x in chunk], np.int64)[found.rows] + found.first - offsets[found.rows]
        return _passed(data.tobytes(), found, anchors, no_id, key, first, length)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for pieces that share a crowded anchor, cut by anchors of another hash."""
        for batch in batches:
            yield from map(cut, _in_chunks(_wanted(batch, length), CHUNK_BYTES, lambda x: len(x[0])))

    return find


def _digests(length: int):
    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for piece, _, no_id, key, first in _wanted(batch, length):
            for i in range(len(piece) - length + 1):
                yield blake2b(piece[i : i + length], digest_size=DIGEST_BYTES).digest(), no_id, key, first + i

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per place of a window; windows that repeat in a chunk but for the first without digest."""
        for batch in batches:
            for chunk in _in_chunks(windows(batch), DIGESTED_WINDOWS, lambda _: 1):
                columns = list(zip(*chunk, strict=True))
                no_id, key, first = (np.array(c) for c in columns[1:])
                same, several = _copies(columns[0], no_id, key, first)
                copy = same != np.arange(len(same))
                sent = np.flatnonzero(~copy | several)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if copy[i] else columns[0][i] for i in sent.tolist()], pa.binary()),
                        pa.array(no_id[sent], pa.bool_()), pa.array(key[sent], pa.int64()),
                        pa.array(first[sent].astype(np.int32)), pa.array(several[sent]),
                    ],
                    names=["digest", "no_id", "key", "first", "several"],
                )

    return digest


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), kind), dtype=kind)


def _send(length: int, buckets: int):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[tuple]] = {}
            for piece, anchor, *place in _wanted(batch, length):
                parts.setdefault(anchor % buckets, []).append((piece, *place))
            out = []
            for bucket, found in parts.items():
                kinds = (np.int8, np.int64, np.int32)
                places = [_pack(np.array([x[i + 1] for x in found], kind)) for i, kind in enumerate(kinds)]
                windows = np.array([len(x[0]) - length + 1 for x in found], np.int32)
                out.append((bucket, zstandard.compress(b"".join([x[0] for x in found]), 3), *places, _pack(windows)))
            if out:
                kinds = (pa.int32(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                    names=["bucket", "data", "no_ids", "keys", "firsts", "windows"],
                )

    return send


class Group(NamedTuple):
    """Pieces that are searched together, and where each stands."""

    parts: list[bytes]
    no_ids: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray


def _marked(group: Group, length: int, seed: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(no_id, key, first, windows) of runs of windows that occur elsewhere in the group."""
    same, several = _copies(group.parts, group.no_ids, group.keys, group.firsts)
    own = np.flatnonzero(same == np.arange(len(same)))
    total = sum(len(group.parts[i]) for i in own.tolist())
    if total > 4 * BUCKET_BYTES and seed < 8:
        yield from _dealt(group, length, seed + 1)
        return
    sizes = np.array([len(group.parts[i]) for i in own.tolist()], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"".join([group.parts[i] + b"\0" for i in own.tolist()]), np.uint8)
    valid = np.arange(len(text)) + length <= np.repeat(starts + sizes, sizes + 1)
    twice = repeated(text, valid, length)
    # A part that stands at several places is repeated as a whole.
    twice |= valid & np.repeat(several[own], sizes + 1)
    breaks = np.zeros(len(text), bool)
    breaks[starts] = True
    at, windows = rolling.runs(twice, breaks)
    part = np.searchsorted(starts, at, "right") - 1
    # Every occurrence of a part gets the runs of that part.
    nth = np.zeros(len(same), np.int64)
    nth[own] = np.arange(len(own))
    low, high = np.searchsorted(part, nth[same], "left"), np.searchsorted(part, nth[same], "right")
    count = high - low
    who = np.repeat(np.arange(len(same)), count)
    run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    yield group.no_ids[who], group.keys[who], group.firsts[who] + at[run] - starts[part[run]], windows[run]


def _dealt(group: Group, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for a large group, dealt out by anchors of another hash."""
    parts: dict[int, list[tuple]] = {}
    total = sum(map(len, group.parts))
    number = -(-total // BUCKET_BYTES)
    for i, part in enumerate(group.parts):
        found = pieces(np.frombuffer(part, np.uint8), np.array([0, len(part)]), length, seed)
        for first, windows, anchor in zip(
            found.first.tolist(), found.windows.tolist(), found.anchors.tolist(), strict=True
        ):
            parts.setdefault(anchor % number, []).append((part[first : first + windows + length - 1], i, first))
    for found in parts.values():
        who = np.array([x[1] for x in found])
        firsts = group.firsts[who] + np.array([x[2] for x in found])
        smaller = Group([x[0] for x in found], group.no_ids[who], group.keys[who], firsts)
        yield from _marked(smaller, length, seed + 8 * (sum(map(len, smaller.parts)) > total // 2))


def _search(length: int):
    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for data, windows, *_ in rows:
            text, at = zstandard.decompress(data), 0
            for n in (windows + length - 1).tolist():
                parts.append(text[at : at + n])
                at += n
        group = Group(parts, *(np.concatenate([r[i] for r in rows]) for i in (2, 3, 4)))
        for no_ids, keys, firsts, windows in _marked(group, length):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(no_ids.astype(bool)), pa.array(keys, pa.int64()),
                    pa.array(firsts.astype(np.int32)), pa.array(windows.astype(np.int32)),
                ],
                names=["no_id", "key", "first", "windows"],
            )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if row["bucket"] != bucket and rows:
                    yield from answer(rows)
                    rows = []
                bucket = row["bucket"]
                rows.append(
                    (
                        row["data"], _unpack(row["windows"], np.int32), _unpack(row["no_ids"], np.int8),
                        _unpack(row["keys"], np.int64), _unpack(row["firsts"], np.int32),
                    )
                )
        if rows:
            yield from answer(rows)

    return search


def _live(places: DataFrame, length: int, name: str) -> DataFrame:
    """Places whose anchor repeats, with the bytes (`size`) of all pieces of that anchor."""
    own = W.partitionBy("anchor")
    met, size = F.sum("weight").over(own), F.sum(F.col("windows") + F.lit(length - 1)).over(own)
    counted = places.where("anchor is not null").withColumn("met", met).withColumn("size", size)
    return write_table(counted.where("met > 1").select("no_id", "key", "anchor", "first", "windows", "size"), name)


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    wanted = places.groupBy("no_id", "key").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("places"))
    return texts.join(wanted, ["no_id", "key"])


def _by_digest(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Marks of single windows whose digest stands at two places or more."""
    rows = write_table(_with_places(texts, places).mapInArrow(_digests(length), _DIGESTS), "digests")
    place = F.struct("no_id", "key", "first")
    per = rows.where("digest is not null").groupBy("digest").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.max("several").alias("several")
    )
    twice = per.where((F.col("a") != F.col("b")) | F.col("several")).select("digest")
    marked = rows.where("digest is null").drop("digest").unionByName(rows.join(twice, "digest", "left_semi").drop("digest"))
    return marked.select("no_id", "key", "first", F.lit(1).alias("windows"))


def sent_pieces(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """What `keyed` documents send to buckets of about `bucket_bytes`, and marks found without that."""
    arrow_limits(docs.sparkSession)
    texts = docs.select("no_id", "key", "text")
    limit = CROWDED * bucket_bytes
    places = write_table(texts.mapInArrow(_find(length), _PLACES), "places")
    live = _live(places, length, "live")
    marked = [places.where("anchor is null")]
    sent, crowd = live.where(F.col("size") <= limit), live.where(F.col("size") > limit)
    if not crowd.isEmpty():
        again = write_table(_with_places(texts, crowd).mapInArrow(_find_again(length), _PLACES), "places-again")
        live = _live(again, length, "live-again")
        marked.append(again.where("anchor is null"))
        sent, crowd = sent.unionByName(live.where(F.col("size") <= limit)), live.where(F.col("size") > limit)
        if not crowd.isEmpty():
            marked.append(_by_digest(texts, crowd, length))
    buckets = max(1, text_bytes(docs) // bucket_bytes)
    return _with_places(texts, sent).mapInArrow(_send(length, buckets), _SENT), marked


def marks(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(no_id, key, first, windows): runs of windows of `keyed` documents that occur elsewhere."""
    sent, marked = sent_pieces(docs, length, bucket_bytes)
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search(length), _MARKS)
    for more in marked:
        found = found.unionByName(more.select("no_id", "key", "first", "windows"))
    return found


def _kept(length: int):
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed, spans = [], [], [], []
            for text, places in zip(
                batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True
            ):
                gone = np.zeros(len(text) + 1, np.int64)
                for p in places or ():
                    gone[min(p["first"], len(text))] += 1
                    gone[min(p["first"] + p["windows"] + length - 1, len(text))] -= 1
                out = np.cumsum(gone)[:-1] > 0
                first, size = rolling.runs(out, np.zeros(len(out), bool))
                texts.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                sizes.append(len(text))
                removed.append(int(out.sum()))
                spans.append([{"first": a, "bytes": n} for a, n in zip(first.tolist(), size.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))),
                    pa.array(texts, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_bytes"],
            )

    return kept


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans, kept_bytes.

    A byte of a text in UTF-8 is removed if a string of `length` bytes covers it that also starts at
    another place, in any document. All occurrences go, the first one too; `spans` has the removed runs.
    Null texts are empty. Rows that share an id are one place, so repeated rows do not count as
    copies of each other; if their texts differ, what is marked in one is removed from each. Rows
    without an id are told apart by a hash of their text. Other columns are not read, and an
    empty table gives an empty result.
    """
    rows = keyed(narrow(docs, doc_id, text))
    found = write_table(marks(rows, length), "marks")
    spans = found.groupBy("no_id", "key").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    return (
        rows.join(spans, ["no_id", "key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _kept(length),
            "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first: bigint, bytes: bigint>>,"
            " kept_bytes binary",
        )
    )
