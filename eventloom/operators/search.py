"""Field-filtered, boolean and ranked text search over events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.functions.cursors import Cursor, decode_cursor
from eventloom.functions.fields import field
from eventloom.functions.timeops import as_datetime, floor_to, ts_lit
from eventloom.operators.retrieval import cut_page, newest_first
from eventloom.operators.vector import fuse, vector_search
from eventloom.plans.pruning import between
from eventloom.schemas import is_error, page_size
from eventloom.sources.store import write_by_day


def with_filters(ev: DataFrame, filters: dict[str, str]) -> DataFrame:
    for name, value in filters.items():
        ev = ev.where(field(name) == value)
    return ev


def match_text(ev: DataFrame, query: str) -> DataFrame:
    """Rows that satisfy the field filters and the boolean text of a search string."""
    wanted = T.read_search(query)
    ev = with_filters(ev, wanted.filters)
    return ev.where(T.matches(wanted.alternatives)) if wanted.alternatives else ev


def search_order(ranked: bool) -> list[Column]:
    return [F.desc("rank"), *newest_first()] if ranked else newest_first()


ANALYZERS = ("standard", "english")


def _terms(alternatives: Sequence[Sequence[T.Term]], analyzer: str) -> Sequence[Sequence[T.Term]]:
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {analyzer}")
    return T.english_terms(alternatives) if analyzer == "english" else alternatives


def _with_hits(ev: DataFrame, alternatives: Sequence[Sequence[T.Term]], analyzer: str) -> tuple[DataFrame, Column | None]:
    """The rows that match, and their hits by position: for `english` a column `_hits`, stemmed once per row."""
    if analyzer == "standard":
        return ev.where(T.matches(alternatives)), None
    words = sorted({t.word for terms in alternatives for t in terms})
    if not words:
        return ev.where(F.lit(False)), F.array().cast("array<struct<pos:int,term:string,weight:double>>")
    hits = F.filter(T.english_document(), lambda d: d["term"].isin(*words))
    # Behind a generator the hits are worked out once, not again in each place that uses them.
    found = ev.withColumn("_hits", F.explode(F.array(hits))).where(T.holds_terms(alternatives, F.col("_hits")))
    wanted = sorted({t.word for terms in alternatives for t in terms if not t.negated})
    return found, F.filter("_hits", lambda d: d["term"].isin(*wanted)) if wanted else F.col("_hits")


def search_events(
    ev: DataFrame,
    query: str | None,
    *,
    as_of: datetime | str,
    source: str | None = None,
    severity: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    after: tuple[float, datetime | str, str] | None = None,
    analyzer: str = "standard",
) -> DataFrame:
    """All matches with their `rank`, zero when the query has no free text.

    An explicit source replaces the one in the query; an explicit severity counts only
    when the query has none. `after` is (rank, timestamp, event_id) of the last row seen. With the
    analyzer `english` words match and rank by their stems; a query of stop words alone matches nothing.
    """
    wanted = T.read_search(query)
    filters = dict(wanted.filters)
    if source:
        filters["source"] = source
    if severity:
        filters.setdefault("severity", severity)
    if start is None:
        start = as_datetime(as_of) - timedelta(hours=24)
    found = with_filters(between(ev, start, end), filters)
    rank = F.lit(0.0)
    if wanted.alternatives:
        terms = _terms(wanted.alternatives, analyzer)
        found, hits = _with_hits(found, terms, analyzer)
        rank = T.cover_density_rank(terms, hits)
        if after is not None:
            # Behind a generator the rank is worked out once for the condition and the result.
            rank = F.explode(F.array(rank))
    found = found.withColumn("rank", rank)
    if after is not None:
        last_rank, moment, event_id = after
        older = (F.col("timestamp") < ts_lit(moment)) | (
            (F.col("timestamp") == ts_lit(moment)) & (F.col("event_id") < event_id)
        )
        if wanted.alternatives:
            at = F.lit(float(last_rank))
            older = (F.col("rank") < at) | ((F.col("rank") == at) & older)
        found = found.where(older)
    return found.drop("_hits")


def search_page(
    ev: DataFrame,
    query: str | None,
    *,
    limit: int | None = None,
    cursor: Cursor | str | None = None,
    **options: object,
) -> DataFrame:
    """One page of matches, best first, with position, has_more and next_cursor.

    `cursor` is the next_cursor of the page before; on ranked pages it holds the rank too.
    """
    ranked = bool(T.read_search(query).alternatives)
    if cursor is not None:
        at = decode_cursor(cursor) if isinstance(cursor, str) else cursor
        if ranked and at.rank is None:
            raise ValueError("a ranked page goes on from a cursor with a rank")
        options["after"] = (at.rank or 0.0, at.timestamp, at.event_id)
    found = search_events(ev, query, **options)
    return cut_page(found, search_order(ranked), page_size(limit), F.col("rank") if ranked else None)


def match_english(ev: DataFrame, query: str) -> DataFrame:
    """Field filters and boolean text, words compared by their English stems.

    Stop words of the query are left out; alternatives of nothing else match nothing.
    """
    wanted = T.read_search(query)
    ev = with_filters(ev, wanted.filters)
    if not wanted.alternatives:
        return ev
    return _with_hits(ev, _terms(wanted.alternatives, "english"), "english")[0].drop("_hits")


def term_table(ev: DataFrame, keep: Sequence[str] = (), with_field: bool = False) -> DataFrame:
    """The weighted search document as rows (event_id, term, weight, pos, *keep), if asked with the number of the `field`.

    Weight and field follow from the position, as fields follow one another.
    """
    fields = T.field_tokens()
    split = ev.select("event_id", *keep, *(found.alias(f"_f{i}") for i, (found, _) in enumerate(fields)))
    names = [f"_f{i}" for i in range(len(fields))]
    sized = split.select("event_id", *keep, F.concat(*names).alias("_all"), *(F.size(n).alias(n) for n in names))
    weight, number, end = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(0)
    for i, (name, (_, value)) in enumerate(zip(names, fields, strict=True)):
        end = end + F.col(name)
        weight = F.coalesce(weight, F.when(F.col("pos") < end, F.lit(value)))
        number = F.coalesce(number, F.when(F.col("pos") < end, F.lit(i)))
    # The outer form keeps Catalyst from tokenizing once more to skip empty arrays.
    rows = sized.select("event_id", *keep, *names, F.posexplode_outer("_all").alias("pos", "term"))
    own = [number.alias("field")] if with_field else []
    return rows.where(F.col("pos").isNotNull()).select("event_id", "term", weight.alias("weight"), "pos", *own, *keep)


def write_term_table(ev: DataFrame, path: str) -> None:
    """Store the terms of events by day, sorted by term, for searches that come often.

    Parquet statistics then skip all row groups without the wanted words.
    """
    write_by_day(term_table(ev, keep=["timestamp"], with_field=True), path, sort=("term", "event_id"))


def match_indexed(terms: DataFrame, query: str) -> DataFrame:
    """Ids and ranks of the events that match the free text, from a term table alone.

    Reads only rows of the words asked for. Hits are gathered per event, so a word that
    very many events hold is no hot group. Every alternative needs a word that is not
    negated, as events without any of the words are not looked at.
    """
    wanted = T.read_search(query)
    if wanted.filters or not wanted.alternatives:
        raise ValueError("a term table answers free text only")
    if not all(any(not t.negated for t in terms) for terms in wanted.alternatives):
        raise ValueError("each alternative needs a word that is not negated")
    words = list(dict.fromkeys(t.word for group in wanted.alternatives for t in group))
    seen = [F.bool_or(F.col("term") == w).alias(f"_w{i}") for i, w in enumerate(words)]
    positive = F.when(F.col("term").isin(*wanted.words), F.struct("pos", "term", "weight"))
    gathered = (
        terms.where(F.col("term").isin(*words))
        .groupBy("event_id")
        .agg(*seen, F.sort_array(F.collect_list(positive)).alias("_hits"))
    )

    def holds(term: T.Term) -> Column:
        found = F.col(f"_w{words.index(term.word)}")
        return ~found if term.negated else found

    either = [reduce(Column.__and__, [holds(t) for t in group]) for group in wanted.alternatives]
    rank = T.cover_density_rank(wanted.alternatives, F.col("_hits"))
    return gathered.where(reduce(Column.__or__, either)).select("event_id", rank.alias("rank"))


def keyword_search(ev: DataFrame, query: str, limit: int, analyzer: str = "standard") -> DataFrame:
    """Events that hold every word (with `english`, its stem), by summed weights of the occurrences."""
    words = list(dict.fromkeys(T.clean_word(w) for w in query.split()))
    terms = _terms([[T.Term(w) for w in words]], analyzer)
    found, hits = _with_hits(ev, terms, analyzer)
    wanted = list(dict.fromkeys(t.word for group in terms for t in group))
    return (
        found.withColumn("score", T.frequency_rank(wanted, hits))
        .drop("_hits")
        .orderBy(F.desc("score"), "event_id")
        .limit(limit)
    )


def hybrid_search(
    ev: DataFrame,
    vectors: DataFrame | None,
    query: str,
    vector: Sequence[float] | None,
    limit: int,
    analyzer: str = "standard",
) -> DataFrame:
    """The best `limit` events by rank fusion of word and vector hits, twice as many of each.

    Without vectors, or without one for the query, the words alone decide.
    """
    words = keyword_search(ev, query, 2 * limit, analyzer)
    near = None if vectors is None or vector is None else vector_search(vectors, vector, 2 * limit)
    return fuse(words, near, limit)


def phrase_search(ev: DataFrame, phrase: str) -> DataFrame:
    return ev.where(T.has_phrase(phrase.split()))


def phrase_indexed(terms: DataFrame, phrase: str) -> DataFrame:
    """(event_id, hits) of the events that hold the words side by side in one field, from a stored term table alone.

    A word that is the i-th of the phrase votes for the phrase to begin i places before it, in its field. It does
    where every word votes: positions are intersected by counting votes, which combine before the shuffle, and no event
    text is read. Only rows of the words are, so a word that very many events hold is no hot group.
    """
    words = [T.clean_word(w) for w in phrase.split()]
    if not words:
        raise ValueError("a phrase needs a word")
    places = F.create_map(
        *(x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w))))
    )
    votes = terms.where(F.col("term").isin(*words)).select(
        "event_id", "field", "pos", F.explode(places[F.col("term")]).alias("place")
    )
    begins = votes.groupBy("event_id", "field", (F.col("pos") - F.col("place")).alias("begin")).agg(F.count("*").alias("n")).where(F.col("n") == len(words))
    return begins.groupBy("event_id").agg(F.count("*").alias("hits"))


def embedding_text(ev: DataFrame) -> DataFrame:
    """The text an embedding of the event is made from."""
    return ev.withColumn(
        "embedding_text", F.concat_ws(" ", "source", "event_type", "severity", "data")
    )


def log_patterns(ev: DataFrame, column: str = "data") -> DataFrame:
    """Masked templates with their count, errors and the first text seen.

    Texts that differ only in masked parts fall into one group; counts combine before
    the shuffle, so a very common template is no hot task.
    """
    return ev.groupBy(T.log_template(F.col(column)).alias("template")).agg(
        F.count("*").alias("count"),
        F.count_if(is_error(F.col("severity"))).alias("errors"),
        F.min_by(column, F.struct("timestamp", "event_id")).alias("sample"),
        F.count_distinct("source").alias("sources"),
    )


def dependency_edges(
    ev: DataFrame, service: Column, *, gap_seconds: int = 1800, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Calls between consecutive services of a user's session: count, errors and latency.

    Neighbours are found per user and hour, with the last call of an hour carried over, so that a service account or
    the events without a user are spread over as many tasks as they have hours.
    """
    from eventloom.functions.fields import duration_ms
    from eventloom.functions.timeops import epoch_seconds
    from eventloom.plans.skew import previous

    calls = ev.select(
        *keys, "timestamp", "event_id", service.alias("service"), "severity", duration_ms().alias("ms")
    )
    order = ["timestamp", "event_id"]
    edged = previous(
        calls, list(keys), floor_to(F.col("timestamp"), "1 hour"), order, ["service", "timestamp"], "_from"
    )
    waited = epoch_seconds(F.col("timestamp")) - epoch_seconds(F.col("_from.timestamp"))
    calls_between = edged.where(
        (waited <= gap_seconds) & (F.col("_from.service") != F.col("service"))
    )
    failed = F.count_if(is_error(F.col("severity")))
    return calls_between.groupBy(
        F.col("_from.service").alias("caller"), F.col("service").alias("callee")
    ).agg(
        F.count("*").alias("calls"),
        (failed / F.count("*")).alias("error_rate"),
        F.avg("ms").alias("mean_ms"),
    )
