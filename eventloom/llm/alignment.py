"""Alignment of two tokenizers by divide and conquer at shared cuts.

Between two other characters, a single space begins a new token in both tokenizers, so texts are made of units
that start there. Units are encoded and aligned once per chunk. For the alignment, a byte offset where
tokens of both end is looked for from the middle of an interval outwards, each probe a bisection; both
halves go on in the same way, and an interval without such an offset is a group. All intervals of
a chunk take their probes together.

A pair of ids is counted over the corpus by a shuffle of chunk counts. Each chunk gets the counts of its own pairs
back by a second shuffle, or all counts if these are few enough for every task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SMALL_GROUPS, arrow_limits, write_table

CHUNK_BYTES = 4 << 20
ROW_BYTES = 128 << 10
ENCODE = 4096
# Units that are encoded as one text.
JOINED = 16
BROADCAST_ROWS = 1_000_000
# Files of the two tokenizers.
BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"

CUT = re.compile(r"(?<=\S) (?=\S)")

_TOTALS = ("n_a", "n_b", "n_groups", "n_links")
ENCODED = (
    "chunk bigint, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint,"
    " begin: bigint, end: bigint, groups_sha256: string>>, links binary, times binary, pairs binary, counts binary"
)
COUNTS = "chunk bigint, pair bigint, n bigint"
ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


def default_folder() -> str:
    """Where the installed tokenizer files lie."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(BYTE_FILE))


@dataclass
class Files:
    """Contents of both vocabulary files, which travel with the job: some 2 MB, whatever the data."""

    byte_json: str
    piece_model: bytes


def read_files(folder: str) -> Files:
    place = Path(folder)
    return Files((place / BYTE_FILE).read_text(encoding="utf-8"), (place / PIECE_FILE).read_bytes())


def _byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the number of bytes of every id."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.piece_model)
        letters = _byte_letters()
        vocab = json.loads(files.byte_json)["model"]["vocab"]
        a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of the texts by both; the first gets a space in front, which the second adds."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(texts, num_threads=1)

    def faithful(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both spell each unit, byte for byte."""
        want = [(" " + u).encode() for u in units]
        return [
            b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y])
            for w, x, y in zip(want, a, b, strict=True)
        ]

    def numbers(self, units: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """Of all units put together, the numbers of tokens in each, if both spell all and no token is of two units."""
        text = "".join([" " + u for u in units])
        want = text.encode()
        sizes = map(len, units) if len(want) == len(text) else (len(u.encode()) for u in units)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(units)) + 1)
        counts = []
        for ids, own, spelled in ((a, self.a_sizes, self.a_bytes), (b, self.b_sizes, self.b_bytes)):
            upto = _offsets(own[ids])
            tokens = np.searchsorted(upto, ends, "right") - 1
            if (upto[tokens] != ends).any() or b"".join(map(spelled.__getitem__, ids.tolist())) != want:
                return None
            counts.append(np.diff(tokens, prepend=0))
        return np.column_stack(counts)


def _joined(units: list[str], most: int) -> Iterator[list[str]]:
    """Up to `most` units each that can stand as they were cut: with a single space between two other characters."""
    own: list[str] = []
    open_ = False
    for unit in units:
        inner = unit.strip() == unit
        if own and not (inner and open_ and len(own) < most):
            yield own
            own = []
        own.append(unit)
        open_ = inner
    if own:
        yield own


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Places in `ends_a`, ascending, whose value is in `ends_b` too, the last one among them.

    Every interval (low, high] of places is searched from its middle outwards for an end that a bisection finds
    in `ends_b`. There it falls into two; one without any is a group.
    """
    cuts = [np.array([len(ends_a) - 1])] if len(ends_a) else [np.empty(0, np.int64)]
    low, high = np.array([0]), np.array([len(ends_a) - 1])  # inner ends are low .. high - 1
    step = np.zeros(1, np.int64)
    while True:
        width = high - low
        open_ = step < width
        low, high, step, width = low[open_], high[open_], step[open_], width[open_]
        if not len(low):
            break
        # 0, +1, -1, +2, -2 ... from the middle: within the interval for as many steps as it is wide.
        away = (step + 1) // 2
        at = low + (width - 1) // 2 + np.where(step % 2 == 1, away, -away)
        value = ends_a[at]
        found = ends_b[np.minimum(np.searchsorted(ends_b, value), len(ends_b) - 1)] == value
        cut = at[found]
        cuts.append(cut)
        low = np.concatenate((low[~found], low[found], cut + 1))
        high = np.concatenate((high[~found], cut, high[found]))
        step = np.concatenate((step[~found] + 1, np.zeros(2 * len(cut), np.int64)))
    return np.sort(np.concatenate(cuts))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, place in b) of all token pairs whose byte ranges overlap; both cover the same bytes."""
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Aligned:
    """Units of a chunk: whether they are spelled exactly, group texts, links as places in `pairs`, and sizes."""

    faithful: np.ndarray
    groups: list[str]
    offsets: np.ndarray
    links: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32)


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _together(units: list[str], tokenizers: Tokenizers, most: int = JOINED) -> Encoded:
    """`encoded` for units as texts of some each; only those of a text that is not spelled exactly go one by one."""
    runs = list(_joined(units, most))
    texts = [" ".join(own) for own in runs]
    a, b = tokenizers.encode(texts)
    good = np.ones(len(units), bool)
    ids = _flat(a), _flat(b)
    counts = tokenizers.numbers(units, *ids)
    if counts is None:
        spelled = tokenizers.faithful(texts, a, b)
        alone = [u for own, g in zip(runs, spelled, strict=True) if not g for u in own]
        of_a, of_b = tokenizers.encode(alone)
        each = iter(list(zip(of_a, of_b, tokenizers.faithful(alone, of_a, of_b), strict=True)))
        kept: list[tuple[list[int], list[int]]] = []
        marks: list[bool] = []
        for own, x, y, g in zip(runs, a, b, spelled, strict=True):
            found = [(x, y, True)] if g else list(islice(each, len(own)))
            kept += [(x, y) for x, y, fits in found if fits]
            marks += [True] * len(own) if g else [fits for *_, fits in found]
        good = np.array(marks, bool)
        ids = _flat([x for x, _ in kept]), _flat([y for _, y in kept])
        own_counts = tokenizers.numbers([u for u, g in zip(units, marks, strict=True) if g], *ids)
        if own_counts is None:
            return _together(units, tokenizers, 1)
        counts = np.zeros((len(units), 2), np.int64)
        counts[good] = own_counts
    return *ids, counts, good


def encoded(units: list[str], tokenizers: Tokenizers) -> Encoded:
    """(ids of a, ids of b, their numbers by unit, whether a unit is spelled exactly); others have no tokens."""
    parts = [_together(units[i : i + ENCODE], tokenizers) for i in range(0, len(units), ENCODE)]
    none = np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, 2), np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*(parts or [none]), strict=True))


def _written(ids: np.ndarray, last: np.ndarray, within: str, end: str) -> np.ndarray:
    """Each id as text with what follows it; one object for all equal ones."""
    known, place = np.unique(2 * ids + last, return_inverse=True)
    return np.array([f"{i // 2}{end if i % 2 else within}" for i in known.tolist()] + [""], object)[place]


def _spelled_groups(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, upto: np.ndarray) -> list[str]:
    """Per unit its groups `a1,a2|b1;`, written token by token; `upto` counts the groups before each unit."""
    group_a = np.searchsorted(cuts_a, np.arange(len(a)), "left")
    group_b = np.searchsorted(cuts_b, np.arange(len(b)), "left")
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cuts_a], last_b[cuts_b] = True, True
    # A token comes after all of a and b in the groups before, and b's after all of a in its own.
    before_b, before_a = _offsets(np.bincount(group_b, minlength=len(cuts_b))), np.append(cuts_a, -1) + 1
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + before_b[group_a]] = _written(a, last_a, ",", "|")
    out[np.arange(len(b)) + before_a[group_b]] = _written(b, last_b, ",", ";")
    ends = np.append(0, np.where(upto > 0, cuts_a[upto - 1] + cuts_b[upto - 1] + 2, 0)[1:]) if len(cuts_a) else 0 * upto
    parts, ends = out.tolist(), ends.tolist()
    return ["".join(parts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def align(units: list[str], tokenizers: Tokenizers) -> Aligned:
    a, b, counts, faithful = encoded(units, tokenizers)
    ends_a, ends_b = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
    cuts = shared_cuts(ends_a, ends_b)
    cuts_b = np.searchsorted(ends_b, ends_a[cuts])
    upto = _offsets(counts[:, 0])
    groups_upto = np.searchsorted(cuts, upto, "left")
    groups = _spelled_groups(a, b, cuts, cuts_b, groups_upto)
    at_a, at_b = overlaps(ends_a, ends_b)
    offsets = np.searchsorted(at_a, upto, "left")
    pairs, links = np.unique(a[at_a].astype(np.int64) * len(tokenizers.b_sizes) + b[at_b], return_inverse=True)
    sizes = np.column_stack((counts, np.diff(groups_upto), np.diff(offsets)))
    return Aligned(faithful, groups, offsets, links.astype(np.int32), sizes, pairs)


def digest(parts: list[str]) -> str:
    """Hash of the parts put together without their last semicolon, without holding the whole."""
    found = hashlib.sha256()
    for i in range(0, len(parts), 1 << 16):
        text = "".join(parts[i : i + (1 << 16)])
        found.update((text if i + (1 << 16) < len(parts) else text[:-1]).encode())
    return found.hexdigest()


_DOC = pa.struct(
    [("doc_id", pa.int64()), *((name, pa.int64()) for name in (*_TOTALS, "begin", "end")), ("groups_sha256", pa.string())]
)
_ENCODED = pa.schema(
    [("chunk", pa.int64()), ("docs", pa.list_(_DOC))]
    + [(name, pa.binary()) for name in ("links", "times", "pairs", "counts")]
)


def _row(chunk: int, docs: list[tuple], ends: list[int], units: np.ndarray, made: Aligned) -> dict:
    """A row of documents, `units` in a row cut at `ends`: their totals, and how often each pair is linked in each.

    Of `links` (places in `pairs`) and `times`, a document has those from begin to end; `counts` are of the whole row.
    """
    rows, owner, used, begin = [], [], [], 0
    for i, ((doc_id, _), end) in enumerate(zip(docs, ends, strict=True)):
        mine = units[begin:end]
        # Units that are not spelled exactly leave out bytes, so the text isn't spelled exactly either.
        if end == begin or not made.faithful[mine].all():
            mine = mine[:0]
        sha = digest([made.groups[u] for u in mine.tolist()]) if len(mine) else ""
        total = made.sizes[mine].sum(axis=0).tolist()
        rows.append({"doc_id": doc_id, **dict(zip(_TOTALS, total, strict=True)), "groups_sha256": sha})
        owner.append(np.full(len(mine), i, np.int64))
        used.append(mine)
        begin = end
    used, owner = np.concatenate(used), np.concatenate(owner)
    n_links = made.sizes[used, 3]
    upto = _offsets(n_links)
    links = made.links[np.repeat(made.offsets[used] - upto[:-1], n_links) + np.arange(upto[-1])]
    present = np.zeros(len(made.pairs), bool)
    present[links] = True
    pairs = np.flatnonzero(present)
    links = (np.cumsum(present) - 1)[links]
    keys, times = np.unique(np.repeat(owner, n_links) * (len(pairs) + 1) + links, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(rows) + 1) * (len(pairs) + 1)).tolist()
    for r, first, last in zip(rows, cuts[:-1], cuts[1:], strict=True):
        r |= {"begin": first, "end": last}
    return {
        "chunk": chunk, "docs": rows, "links": (keys % (len(pairs) + 1)).astype(np.int32).tobytes(),
        "times": times.astype(np.int32).tobytes(), "pairs": made.pairs[pairs].tobytes(),
        "counts": np.bincount(links, minlength=len(pairs)).astype(np.int64).tobytes(),
    }


def _encoded(chunk: int, docs: list[tuple[int | None, bytes]], tokenizers: Tokenizers) -> Iterator[pa.RecordBatch]:
    """Units of all documents are aligned together; rows hold some of the documents each, so that none gets large."""
    own: list[str] = []
    ends = []
    for _, text in docs:
        try:
            own += CUT.split(text.decode()) if text else []
        except UnicodeDecodeError:
            pass
        ends.append(len(own))
    place = dict.fromkeys(own)
    place = dict(zip(place, range(len(place)), strict=True))
    units = np.fromiter(map(place.__getitem__, own), np.int32, len(own))
    del own
    made = align(list(place), tokenizers)
    del place
    first, size = 0, 0
    for i, (_, text) in enumerate(docs):
        size += len(text)
        if size >= ROW_BYTES or i + 1 == len(docs):
            begin = ends[first - 1] if first else 0
            row = _row(chunk, docs[first : i + 1], [e - begin for e in ends[first : i + 1]], units[begin : ends[i]], made)
            yield pa.RecordBatch.from_pylist([row], _ENCODED)
            chunk, first, size = chunk + 1, i + 1, 0


def _encode(files: Files, chunk_bytes: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = None
        # Numbers of rows: fewer than documents, so never as many as a partition has numbers.
        number = TaskContext.get().partitionId() << 40
        docs, size = [], 0
        for batch in batches:
            tokenizers = tokenizers or Tokenizers(files)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                docs.append((doc_id, text))
                size += len(text)
                if size >= chunk_bytes:
                    yield from _encoded(number, docs, tokenizers)
                    number += len(docs)
                    docs, size = [], 0
        if docs:
            yield from _encoded(number, docs, tokenizers)

    return run


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, n) of the links of rows."""
    for batch in batches:
        for chunk, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "counts")), strict=True):
            pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), chunk, np.int64)), pa.array(pairs), pa.array(n)], names=["chunk", "pair", "n"]
            )


_ALIGNED = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with their sums over links; `right` has the counts of the chunk's pairs."""
    known = right.column("pair").to_numpy()
    order = np.argsort(known, kind="stable")
    known = known[order]
    count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
    out = []
    for row in left.to_pylist():
        links, times = np.frombuffer(row["links"], np.int32), np.frombuffer(row["times"], np.int32).astype(np.int64)
        at = np.searchsorted(known, np.frombuffer(row["pairs"], np.int64))[links]
        n_best, total = _offsets(times * best[at]), _offsets(times * count[at])
        for d in row["docs"]:
            a, b = d.pop("begin"), d.pop("end")
            out.append(d | {"n_best": int(n_best[b] - n_best[a]), "count_sum": int(total[b] - total[a])})
    return pa.Table.from_pylist(out, _ALIGNED)


def _told(known: pa.Table) -> Callable:
    """`_summed` where every task has the counts of all pairs."""
    known = known.sort_by("pair")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _summed(pa.Table.from_batches([batch]), known).to_batches()

    return run


def align_tokenizers(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level, B the piece vocabulary in `folder`. Offsets where tokens of both end part
    the tokens into groups; every overlapping pair of tokens is a link. The count of an id pair is its number of
    links in the corpus; n_best are the links whose count no other pair of the same B id exceeds, count_sum is
    the sum of counts over links. groups_sha256 hashes the groups as `a1,a2|b1;a3|b2,b3`.

    Null and empty texts and those that either tokenizer does not spell byte for byte (U+2581, bytes
    that are no UTF-8) have zeros and an empty hash. Repeated rows count each, null ids stay null, an empty table
    gives an empty result, other columns are not read. A task holds a chunk of about `chunk_bytes`, or one text
    if that is longer, with some twenty bytes of arrays per byte of text.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    files = read_files(folder or default_folder())
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    encoded_rows = rows.mapInArrow(_encode(files, chunk_bytes), ENCODED)
    chunks = write_table(encoded_rows, "aligned-chunks", options=SMALL_GROUPS)
    each = chunks.select("chunk", "pairs", "counts").mapInArrow(_pair_counts, COUNTS)
    counts = write_table(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.pmod("pair", F.lit(_piece_ids(files)))
    # One row per id of the vocabulary, whatever the data.
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("b", b_id).join(highest, "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).cast("bigint").alias("best")
    )
    known = write_table(known, "pair-counts")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return chunks.mapInArrow(_told(known.toArrow()), ALIGNED)
    marks = each.select(F.col("chunk").alias("at"), "pair").join(known, "pair").select("at", "pair", "count", "best")
    return chunks.groupBy("chunk").cogroup(marks.groupBy("at")).applyInArrow(_summed, ALIGNED)


def _piece_ids(files: Files) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=files.piece_model).get_piece_size()
