"""Near-duplicate groups of log templates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.groups import linked_groups

# With fewer words, one that differs is more than a fifth of the template.
SHORTEST = 5
WORD = re.compile("[a-z0-9_-]+")
# Variants are named by a polynomial of word hashes modulo a Mersenne prime, so all of a template's take linear time.
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.blake2b(b"near templates", digest_size=15).digest(), "big")
_INVERSE = pow(_BASE, -1, _PRIME)


def variants(words: list[str], shortest: int = SHORTEST) -> list[str]:
    """Names of the word sequence and, if long enough, of all sequences with one word taken out."""
    hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=15).digest(), "big") for w in words]
    power, before = 1, [0]
    for h in hashes:
        before.append((before[-1] + h * power) % _PRIME)
        power = power * _BASE % _PRIME
    n, total = len(words), before[-1]
    names = {f"{n}:{total:x}"}
    if n >= shortest:
        for i in range(n):
            after = (total - before[i + 1]) * _INVERSE
            names.add(f"{n - 1}:{(before[i] + after) % _PRIME:x}")
    return sorted(names)


_LINKS = pa.schema([("node", pa.string()), ("variant", pa.string())])


def _variant_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("template").to_pylist(), strict=True):
            names = variants(WORD.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([node] * len(names), pa.string()), pa.array(names, pa.string())], schema=_LINKS
            )


def near_groups(templates: DataFrame, template: str = "template") -> DataFrame:
    """(template, pattern_group) of the distinct templates; a group is named by its least template.

    Two templates are near when taking at most one word out of each leaves the same words, so one word may
    differ, be added or be missing. Templates of fewer than five words are near only if their words are the
    same. Groups are what is reached over near templates. Templates meet under the names of their variants, of
    which there are as many as words, and never in pairs. A null template is left out.
    """
    distinct = templates.select(F.col(template).cast("string").alias("template")).where("template is not null").distinct()
    named = distinct.select(F.md5("template").alias("node"), "template")
    links = named.mapInArrow(_variant_rows, "node string, variant string")
    rooted = named.join(linked_groups(links, "node", "variant"), "node")
    least = rooted.groupBy("root").agg(F.min("template").alias("pattern_group"))
    return rooted.join(least, "root").select("template", "pattern_group")


def near_patterns(patterns: DataFrame) -> DataFrame:
    """Near groups of `log_patterns`: templates, events and errors of each, with the sample of its least template."""
    grouped = patterns.join(near_groups(patterns), "template")
    return grouped.groupBy("pattern_group").agg(
        F.count("*").alias("templates"),
        F.sum("count").alias("count"),
        F.sum("errors").alias("errors"),
        F.min_by("sample", "template").alias("sample"),
    )
