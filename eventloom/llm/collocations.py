"""Phrase collocations per language, counted by Rabin-Karp fingerprints.

Texts are turned once into chunks of word numbers. Prefix polynomials over bytes name the words, and over words
the n-grams; equal fingerprints are counted in the chunk, the shuffle adds the counts up and keeps a pointer, the
a chunk that holds one. Only there frequent phrases are written out, and every chunk compares its own
occurrences with them; what differs is taken off and counted by itself. No two words of the corpus may share
a frequent fingerprint: they are compared by text, and if two do, the words are named anew.

Counts are packed for the shuffle: sorted fingerprints of some chunks at a time, as differences and cut into ranges. Those
of n-grams have some bits more than the number of words; what collides is told apart by the comparison. A word whose fingerprint
is frequent is written out at one place, too; two of one fingerprint that is not are both rare.

A phrase of `least` occurrences consists of pairs of words with at least as many. So words and all pairs are
counted, which grows as the texts do, and longer phrases where every pair is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import rolling
from eventloom.llm.common import SMALL_GROUPS, arrow_limits, write_table

LEAST = 100
LONGEST = 5
TOP = 2000
CHUNK_BYTES = 2 << 20
ROW_WORDS = 1 << 19
SALTS = 64
BROADCAST_ROWS = 500_000
# Counts that a task packs at a time, and those that a range should have.
PACKED = 1 << 20
RANGE = 1 << 20
BITS = 64
# Bits of an n-gram's fingerprint beyond those that number the words.
SPARE = 7
TIGHT = {**SMALL_GROUPS, "compression": "zstd"}

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# What ends a piece, and what stands between words.
STOPS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

WORDS = "chunk bigint, ids binary, fps binary, lang string, word binary, fp bigint, n bigint"
CHUNKS = "chunk bigint, ids binary, fps binary"
COUNTS = "chunk bigint, fp bigint, n bigint"
PACKS = "range int, size int, data binary"
MARKS = "fp bigint, n bigint, pointer bigint"
PHRASES = "fp bigint, size int, words array<bigint>, n bigint"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2


def _hash(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    zero = np.zeros(1, np.int64)
    return int(rolling.mixed(rolling.range_hashes(data, zero, zero + len(data)), 9)[0])


def _exact(langs: np.ndarray, parts: list[bytes]) -> np.ndarray:
    seen: dict[tuple[int, bytes], int] = {}
    return np.fromiter(
        (seen.setdefault(key, len(seen)) for key in zip(langs.tolist(), parts, strict=True)), np.int64, len(parts)
    )


def _named(langs: list[str], words: list[bytes], seed: int) -> np.ndarray:
    digests = (
        hashlib.blake2b(word, digest_size=8, key=f"{seed}:{lang}".encode()[:64]).digest()
        for lang, word in zip(langs, words, strict=True)
    )
    return np.frombuffer(b"".join(digests), np.uint64)


class Numbered(NamedTuple):
    """Word numbers of texts in their order, -1 between pieces, and fingerprint, language, word and count of each number."""

    ids: np.ndarray
    fps: np.ndarray
    langs: list[str]
    words: list[bytes]
    n: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return list(_cut(self.ids, ROW_WORDS))


def numbered(texts: list[bytes], langs: list[str], seed: int = 0) -> Numbered:
    """With a `seed` words are named by a keyed hash, for the case that the polynomials name two of them alike."""
    raw = (b"\n".join(texts) + b"\n").translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    word = np.concatenate(([False], kind == 0, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, end = edge[::2], edge[1::2]
    names = sorted(set(langs))
    place = {name: i for i, name in enumerate(names)}
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    row = np.searchsorted(begins, first, "right") - 1
    lang = np.array([place[x] for x in langs])[row]
    salt = np.array([_hash(x.encode()) for x in names], np.uint64)
    fps = rolling.mixed(rolling.range_hashes(data, first, end) + salt[lang])
    _, lead, ids, n = np.unique(fps, return_index=True, return_inverse=True, return_counts=True)
    at = lead[ids]
    size = end - first
    same = not seed and (size == size[at]).all() and (lang == lang[at]).all()
    if not (same and rolling.same_ranges(data, first, first[at], size)):
        ids = _exact(lang, [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)])
        _, lead, n = np.unique(ids, return_index=True, return_counts=True)
    piece = np.cumsum(kind == 2)[first]
    breaks = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    words = [raw[a:b] for a, b in zip(first[lead].tolist(), end[lead].tolist(), strict=True)]
    of_words = [names[i] for i in lang[lead].tolist()]
    named = _named(of_words, words, seed) if seed else fps[lead]
    return Numbered(np.insert(ids.astype(np.int32), breaks, -1), named, of_words, words, n)


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """The text, or if longer than the limit, parts of about that size cut where a piece ends."""
    begin = 0
    while len(text) - begin > limit:
        cuts = [x for x in (text.find(bytes([s]), begin + limit) for s in STOPS) if x >= 0]
        if not cuts:
            break
        yield text[begin : min(cuts)]
        begin = min(cuts)
    yield text[begin:] if begin else text


_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("fps", pa.binary())])
_OF_WORD = [("lang", pa.string()), ("word", pa.binary()), ("fp", pa.int64()), ("n", pa.int64())]
Chunk = tuple[int, np.ndarray, np.ndarray]


def _table(chunks: list[Chunk]) -> pa.Table:
    columns = [
        pa.array([chunk for chunk, *_ in chunks], pa.int64()),
        pa.array([ids.astype(np.int32).tobytes() for _, ids, _ in chunks], pa.binary()),
        pa.array([fps.tobytes() for *_, fps in chunks], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, schema=_CHUNK)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[Chunk]:
    for chunk, ids, fps in zip(*(table.column(c) for c in ("chunk", "ids", "fps")), strict=True):
        yield chunk.as_py(), np.frombuffer(ids.as_py(), np.int32), np.frombuffer(fps.as_py(), np.uint64)


def _cut(ids: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Word numbers in parts of about `most`, cut where a piece ends."""
    breaks = np.flatnonzero(ids < 0)
    begin = 0
    while len(ids) - begin > most:
        at = np.searchsorted(breaks, begin + most)
        if at == len(breaks):
            break
        yield ids[begin : breaks[at]]
        begin = breaks[at] + 1
    yield ids[begin:]


def _both(chunk: int, found: Numbered) -> Iterator[pa.RecordBatch]:
    """Rows of the chunk, numbered on from `chunk`, none of them large, then one for each of its words."""
    names = [*_CHUNK.names, *(name for name, _ in _OF_WORD)]
    for k, ids in enumerate(found.parts):
        own = _table([_kept(chunk + k, ids, ids >= 0, found.fps)]).to_batches()[0]
        yield pa.RecordBatch.from_arrays([*own.columns, *(pa.nulls(1, kind) for _, kind in _OF_WORD)], names=names)
    for i in range(0, len(found.words), 1 << 14):
        part = slice(i, i + (1 << 14))
        words = [
            pa.array(found.langs[part], pa.string()), pa.array(found.words[part], pa.binary()),
            pa.array(found.fps[part].view(np.int64)), pa.array(found.n[part].astype(np.int64)),
        ]
        n = len(words[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk, np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *words], names=names
        )


def _chunked(chunk_bytes: int, seed: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of rows are kept short, as they travel with every fingerprint: 2 ** 24 for a partition.
        number = TaskContext.get().partitionId() << 24
        texts, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part in _parts(text.as_py(), chunk_bytes):
                    texts.append(part)
                    langs.append(lang)
                    size += len(part)
                    if size >= chunk_bytes:
                        found = numbered(texts, langs, seed)
                        yield from _both(number, found)
                        texts, langs, size, number = [], [], 0, number + len(found.parts)
        if texts:
            yield from _both(number, numbered(texts, langs, seed))

    return run


def grams(ids: np.ndarray, fps: np.ndarray, size: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint) of each run of `size` words without a break.

    Pairs are even and longer runs odd: they are counted apart, and the one's count must not meet the other's.
    """
    n = len(ids) - size + 1
    if n <= 0 or not len(fps):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    broken = np.concatenate(([0], np.cumsum(ids < 0)))
    at = np.flatnonzero(broken[size:] == broken[:n])
    values = np.where(ids < 0, np.uint64(0), fps[np.maximum(ids, 0)])
    found = rolling.mixed(rolling.range_hashes(values, at, at + size), size) >> np.uint64(64 - bits)
    return at, (found | np.uint64(1)) - np.uint64(size == 2)


def _kept(chunk: int, ids: np.ndarray, use: np.ndarray, fps: np.ndarray) -> Chunk:
    """The chunk with the words under `use` (breaks elsewhere), numbered anew."""
    ids = np.where(use, ids, -1)
    ids = ids[np.append(True, (ids[1:] >= 0) | (ids[:-1] >= 0))] if len(ids) else ids
    left = np.unique(ids[ids >= 0])
    new = np.full(len(fps) + 1, -1, np.int32)
    new[left] = np.arange(len(left), dtype=np.int32)
    return chunk, new[ids], fps[left]


def _fps(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("fp").to_numpy().view(np.uint64))


def _among_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones; by bisection, as a row has few of very many."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _keep_pairs(bits: int) -> Callable:
    """Chunks whose runs go on only from word to word of a frequent pair."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, good = [], _fps(right)
        for chunk, ids, fps in _rows(left):
            at, pairs = grams(ids, fps, 2, bits)
            joined = np.zeros(len(ids) + 1, bool)
            joined[at[_among_sorted(pairs, good)]] = True
            use = joined[:-1] | np.append(False, joined[:-2])
            # A pair that is not frequent parts two runs that lie side by side.
            cut = np.flatnonzero(use[:-1] & use[1:] & ~joined[: len(ids) - 1]) + 1
            out.append(_kept(chunk, np.insert(ids, cut, -1), np.insert(use, cut, False), fps))
        return _table(out)

    return run


_COUNT = pa.schema([("chunk", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])


def _counts(chunk: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    fps, n = np.unique(fps, return_counts=True)
    for i in range(0, len(fps), 1 << 16):
        part = fps[i : i + (1 << 16)].view(np.int64)
        columns = [pa.array(np.full(len(part), chunk, np.int64)), pa.array(part), pa.array(n[i : i + (1 << 16)].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNT)


def _counted(sizes: range, bits: int) -> Callable:
    """Fingerprints of a chunk's n-grams, each once with its count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, values in _rows(batch):
                for size in sizes:
                    yield from _counts(chunk, grams(ids, values, size, bits)[1])

    return run


def _by_text(ids: np.ndarray, at: np.ndarray, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, fingerprint, count) of each different n-gram among those at `at`; equal fingerprints are compared."""
    own, lead, inverse, n = np.unique(fps, return_index=True, return_inverse=True, return_counts=True)
    rows = ids[at[:, None] + np.arange(size)]
    if (rows == rows[lead[inverse]]).all():
        return at[lead], own, n
    _, lead, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[lead], fps[lead], n


_PHRASE = pa.schema([("fp", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.int64())), ("n", pa.int64())])
Spelled = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _spelled(chunk: Chunk, good: np.ndarray, longest: int, bits: int) -> Iterator[Spelled]:
    """For each size (size, fingerprints, word fingerprints of each, counts) of the chunk's n-grams in `good`."""
    _, ids, values = chunk
    for size in range(2, longest + 1):
        at, fps = grams(ids, values, size, bits)
        keep = _among_sorted(fps, good)
        if keep.any():
            places, fps, n = _by_text(ids, at[keep], fps[keep], size)
            yield size, fps, values[ids[places[:, None] + np.arange(size)]], n


def _phrases(found: Iterable[Spelled]) -> pa.Table:
    parts = [
        pa.Table.from_arrays(
            [
                pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), size, np.int32)),
                pa.ListArray.from_arrays(np.arange(len(fps) + 1, dtype=np.int32) * size, words.reshape(-1).view(np.int64)),
                pa.array(n.astype(np.int64)),
            ],
            schema=_PHRASE,
        )
        for size, fps, words, n in found
    ]
    return pa.concat_tables([_PHRASE.empty_table(), *parts])


def _materialise(longest: int, bits: int) -> Callable:
    """The phrases of those fingerprints that point to the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fps, pointer = right.column("fp").to_numpy().view(np.uint64), right.column("pointer").to_numpy()
        order = np.argsort(fps)
        fps, pointer = fps[order], pointer[order]
        return _phrases(x for chunk in _rows(left) for x in _spelled(chunk, fps[pointer == chunk[0]], longest, bits))

    return run


def _verify(longest: int, bits: int) -> Callable:
    """Occurrences in the chunk that are not the phrase of their fingerprint."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, sizes = known[order], right.column("size").to_numpy()[order]
        texts = np.zeros((len(known), longest), np.uint64)
        given = right.column("words").combine_chunks()
        texts[np.arange(longest) < right.column("size").to_numpy()[:, None]] = given.flatten().to_numpy().view(np.uint64)
        texts = texts[order]
        out = []
        for chunk in _rows(left):
            for size, fps, words, n in _spelled(chunk, known, longest, bits):
                at = np.searchsorted(known, fps)
                other = (sizes[at] != size) | (texts[at, :size] != words).any(axis=1)
                if other.any():
                    out.append((size, fps[other], words[other], n[other]))
        return _phrases(out)

    return run


def _sums(fps: np.ndarray, n: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ascending, each once, with the sum of its counts and a chunk that holds it."""
    order = np.argsort(fps)
    fps = fps[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.empty(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(first) else n
    return fps[first], sums, chunks[order][first]


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte of all values, as the high ones are mostly zero."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _pack(fps: np.ndarray, n: np.ndarray, chunks: np.ndarray) -> bytes:
    names, which = np.unique(chunks, return_inverse=True)
    columns = (np.diff(fps, prepend=np.uint64(0)), n, which.astype(np.uint32))
    head = np.array([len(names)], np.int64).tobytes() + names.astype(np.int64).tobytes()
    return zstandard.compress(head + b"".join(map(_planes, columns)), 1)


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    at = 8 + 8 * int(raw[:8].view(np.int64)[0])
    names, columns = raw[8:at].view(np.int64), []
    for kind in (np.uint64, np.int64, np.uint32):
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(raw[at : at + width * size].reshape(width, size).T).view(kind).reshape(-1))
        at += width * size
    return np.cumsum(columns[0]), columns[1], names[columns[2]]


def _packed(ranges: int, bits: int = BITS) -> Callable:
    """(range, number, data): counts of some chunks, added up and cut by their fingerprints."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fps, n, chunks = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
        of = ((fps << np.uint64(BITS - bits) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist() if len(of) else []
        parts = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(of)], strict=False)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(of[cuts]), pa.array([x.stop - x.start for x in parts], pa.int32()),
                pa.array([_pack(fps[x], n[x], chunks[x]) for x in parts], pa.binary()),
            ],
            names=["range", "size", "data"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            chunk, fp, n = (batch.column(c).to_numpy() for c in ("chunk", "fp", "n"))
            held.append((fp.view(np.uint64), n, chunk))
            size += len(fp)
            if size >= PACKED:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return run


def _marks(least: int) -> Callable:
    """Fingerprints of at least `least` occurrences; all packs of a range lie side by side."""

    def marks(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fps, n, chunks = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = n >= least
        columns = [pa.array(fps[keep].view(np.int64)), pa.array(n[keep]), pa.array(chunks[keep])]
        return pa.RecordBatch.from_arrays(columns, names=["fp", "n", "pointer"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for of, n, data in zip(*(batch.column(c) for c in ("range", "size", "data")), strict=True):
                if of.as_py() != last and held:
                    yield marks(held)
                    held, size = [], 0
                last = of.as_py()
                held.append(_unpack(data.as_py(), n.as_py()))
                size += n.as_py()
                if size > 2 * RANGE and len(held) > 1:
                    # What stands in many packs is added up before all of them are there.
                    held = [_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = 0
        if held:
            yield marks(held)

    return run


def _frequent(packs: DataFrame, least: int) -> DataFrame:
    """(fp, n, pointer) of the fingerprints with at least `least` occurrences, and a chunk that holds each."""
    met = packs.repartition("range").sortWithinPartitions("range")
    return write_table(met.mapInArrow(_marks(least), MARKS), "phrase-marks")


def _after(step: Callable, then: Callable) -> Callable:
    return lambda batches: then(step(batches))


def _each(step: Callable, right: pa.Table) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(pa.Table.from_batches([batch]), right).to_batches()

    return run


def _small(few: DataFrame) -> bool:
    return few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _meet(chunks: DataFrame, counts: DataFrame, few: DataFrame, step: Callable, schema: str) -> DataFrame:
    """`step` over each chunk and the rows of the written table `few`, or at least those of the chunk's fingerprints.

    Where `few` is small by count, every task gets all of it; otherwise it is shuffled to the chunks by way of `counts`
    (chunk, fp). Both give the same rows.
    """
    if _small(few):
        return chunks.mapInArrow(_each(step, few.toArrow()), schema)
    marks = counts.select(F.col("chunk").alias("at"), "fp").distinct().join(few, "fp")
    return chunks.groupBy("chunk").cogroup(marks.groupBy("at")).applyInArrow(step, schema)


def _told(few: DataFrame) -> DataFrame:
    """The written table, for a join in which every task gets it where it is small by count."""
    return F.broadcast(few) if _small(few) else few


def _among(rows: DataFrame, few: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """Rows whose `fp`, or columns `on`, are in the written table `few`."""
    return rows.join(_told(few), list(on or ("fp",)), how)


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
    chunk_bytes: int = CHUNK_BYTES, bits: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, phrase, n) and phrases (lang, phrase, size, n) of at least `least` occurrences, and all words per language (lang, n).

    With fewer `bits` to an n-gram's fingerprint (by default as many as the number of words asks for) more of them collide;
    counts are the same.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    seed, alike = 0, True
    while alike:
        found = write_table(rows.mapInArrow(_chunked(chunk_bytes, seed), WORDS), "phrase-chunks", options=TIGHT)
        each = found.where("word is not null").select("chunk", "lang", "word", "fp", "n")
        all_words = write_table(each.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "phrase-langs")
        # One row for the corpus: how many counts there are, and no more pairs than words.
        total = all_words.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).first()
        ranges = 1 + (total["n"] or 0) // RANGE
        of_words = each.select("chunk", "fp", "n").mapInArrow(_packed(1 + (total["rows"] or 0) // RANGE), PACKS)
        often = _frequent(of_words, least).select("fp", "n", F.col("pointer").alias("chunk"))
        words = _among(each.drop("n"), often, "fp", "chunk", how="inner").select("fp", "lang", "word", "n")
        words = write_table(words, "phrase-words")
        first = words.select("fp", F.col("lang").alias("of"), F.col("word").alias("as"))
        alike = bool(_among(each, first, "fp", how="inner").where("lang <> of or word <> as").limit(1).count())
        seed += 1
    bits = bits or min(BITS, SPARE + (total["n"] or 0).bit_length())
    chunks = found.where("ids is not null").select("chunk", "ids", "fps")
    counts = chunks.mapInArrow(_counted(range(2, 3), bits), COUNTS)
    pairs = _frequent(chunks.mapInArrow(_after(_counted(range(2, 3), bits), _packed(ranges, bits)), PACKS), least)
    runs = write_table(_meet(chunks, counts, pairs.select("fp"), _keep_pairs(bits), CHUNKS), "phrase-runs", options=TIGHT)
    packs = _packed(ranges * max(1, longest - 2), bits)
    longer = _frequent(runs.mapInArrow(_after(_counted(range(3, longest + 1), bits), packs), PACKS), least)
    marks = pairs.unionByName(longer).groupBy("fp").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
    marks = write_table(marks, "phrase-marks")
    counts = runs.mapInArrow(_counted(range(2, longest + 1), bits), COUNTS)
    spelled = _meet(runs, counts, marks.select("fp", "pointer"), _materialise(longest, bits), PHRASES)
    # Should fingerprints of one chunk collide, its least phrase stands for them.
    first = spelled.groupBy("fp").agg(F.min(F.struct("size", "words")).alias("p")).select("fp", "p.*")
    first = write_table(first, "phrase-texts")
    others = write_table(_meet(runs, counts, first, _verify(longest, bits), PHRASES), "phrase-others")
    taken = others.groupBy("fp").agg(F.sum("n").alias("taken"))
    exact = (
        first.join(marks.select("fp", "n"), "fp")
        .join(taken, "fp", "left")
        .select("size", "words", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
        .unionByName(others.groupBy("size", "words").agg(F.sum("n").alias("n")))
        .where(F.col("n") >= least)
    )
    known = words.select("fp", "lang", F.col("word").cast("string").alias("phrase"), "n")
    return known.drop("fp"), write_table(_texts(exact, known, longest), "phrases"), all_words.select("lang", "n")


def _texts(phrases: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, n) of phrases given by the fingerprints of their words."""
    told = _told(words.select("fp", "lang", "phrase"))
    placed = phrases.join(told.withColumnRenamed("phrase", "w0"), F.get("words", F.lit(0)) == F.col("fp")).drop("fp")
    for i in range(1, longest):
        word = told.select("fp", F.col("phrase").alias(f"w{i}"))
        placed = placed.join(word, F.get("words", F.lit(i)) == F.col("fp"), "left").drop("fp")
    whole = F.concat_ws(" ", *(f"w{i}" for i in range(longest)))
    return placed.select("lang", whole.alias("phrase"), "size", "n")


def _within(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the most frequent longer phrase around each phrase inside one."""
    words = F.split("phrase", " ")
    inner = F.explode(
        F.expr(
            "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
            " i -> array_join(slice(w, i, m), ' '))))"
        )
    )
    long = phrases.where("size > 2").withColumn("w", words)
    return long.select("lang", "n", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
    top: int = TOP, chunk_bytes: int = CHUNK_BYTES, bits: int | None = None,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and parted at . , ; : ! ? and line ends; words stand between spaces
    and tabs. Phrases of 2 to `longest` words with a >= `least` occurrences are cut where
    floor(1000 * a * n / (l * r)) is least (then as early as possible), l and r being the counts of both
    parts and n all words of the language. Phrases inside a longer one of the same count are left out. Order: score, a
    descending, phrase.

    A null language is `und`, a null text empty; empty tables and those without frequent phrases give
    an empty result. Repeated rows count each. Other columns are not read. A very long text is taken in
    parts cut where a piece ends, so a task holds about `chunk_bytes` of text and the longest piece.
    """
    words, phrases, all_words = phrase_counts(docs, text, lang, least, longest, chunk_bytes, bits)
    known = words.unionByName(phrases.select("lang", "phrase", "n"))
    w = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), w.alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    wide = "decimal(19,0)"
    product = F.col("a").cast(wide) * F.col("n").cast(wide)
    scored = (
        cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(all_words, "lang")
        .withColumn("above", (product * F.lit(1000)).cast("decimal(38,0)"))
        .withColumn("below", (F.col("l").cast(wide) * F.col("r").cast(wide)).cast("decimal(38,0)"))
        .withColumn("score", F.expr("above div below"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    )
    left = (
        scored.join(_within(phrases), ["lang", "phrase"], "left")
        .where(F.col("most").isNull() | (F.col("most") < F.col("a")))
        .drop("most")
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    )
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # A language, however many phrases it has, is ranked in parts first: of each only the best can stay.
    best = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    best = best.where(F.col("rank") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return (
        best.withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
