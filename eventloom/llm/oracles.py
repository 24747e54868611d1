"""DuckDB oracles of the queries that SQL can express."""

from __future__ import annotations

from eventloom.llm import collocations, mixing, packing, quality_rules

SPACE = "[\\x20\\x09-\\x0D]+"
WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

EXACT_DEDUP = f"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([{", ".join(map(str, mixing.WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1)
            % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.MOST} AS cap
  FROM own),
placed AS (
  SELECT *, row_number() OVER ratio AS nth,
         ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE}::DOUBLE
           - coalesce(sum(cap) OVER (ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW ratio AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
opened AS (SELECT min(nth) AS first FROM placed WHERE level * weight <= cap),
aims AS (
  SELECT source, source_size,
         CASE WHEN nth >= first THEN (SELECT level FROM placed, opened WHERE nth = first) * weight
              ELSE cap::DOUBLE END AS target
  FROM placed, opened),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY source
              ORDER BY size DESC, coalesce(doc_id, 0) % {mixing.SPREAD}, doc_id) AS rank
  FROM sized),
taken AS (
  SELECT r.*, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix|' || coalesce(r.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM ranks r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source),
copied AS (SELECT *, (floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT AS copies FROM taken)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied"""


def _packing() -> str:
    """Dynamic programming unrolled: step k has the best cost of the first j lengths in k buckets."""
    steps = ["d0 AS (SELECT 0 AS j, 0::HUGEINT AS cost)"]
    for k in range(1, packing.BUCKETS + 1):
        steps.append(
            f"d{k} AS MATERIALIZED (SELECT h.j, min(p.cost + h.len * (h.upto - coalesce(q.upto, 0))) AS cost,"
            f" min((p.cost + h.len * (h.upto - coalesce(q.upto, 0))) * 1000000 + p.j) % 1000000 AS pick"
            f" FROM d{k - 1} p JOIN hist h ON p.j < h.j LEFT JOIN hist q ON q.j = p.j GROUP BY h.j)"
        )
    last = " UNION ALL ".join(
        f"SELECT {k} AS k, cost FROM d{k}, (SELECT max(j) AS top FROM hist) WHERE j = top"
        for k in range(1, packing.BUCKETS + 1)
    )
    picks = " UNION ALL ".join(f"SELECT {k} AS k, j, pick FROM d{k}" for k in range(1, packing.BUCKETS + 1))
    return f"""
WITH RECURSIVE sized AS (SELECT doc_id, {WORDS}::BIGINT AS n_tokens FROM documents),
hist AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens::HUGEINT AS len,
         sum(count(*)) OVER (ORDER BY n_tokens) AS upto
  FROM sized GROUP BY n_tokens),
{", ".join(steps)},
picks AS MATERIALIZED ({picks}),
chosen AS (SELECT min(k) AS k FROM ({last}) WHERE cost = (SELECT min(cost) FROM ({last}))),
back AS (
  SELECT k, (SELECT max(j) FROM hist) AS j FROM chosen
  UNION ALL
  SELECT b.k - 1, p.pick::BIGINT FROM back b JOIN picks p ON p.k = b.k AND p.j = b.j WHERE b.k > 1),
bounds AS (
  SELECT k - (SELECT min(k) FROM back) AS bucket, len::BIGINT AS bucket_len,
         lag(len::BIGINT, 1, -1) OVER (ORDER BY k) AS above
  FROM back JOIN hist USING (j)),
placed AS (
  SELECT s.*, b.bucket::INT AS bucket, b.bucket_len,
         row_number() OVER (PARTITION BY b.bucket ORDER BY coalesce(doc_id, 0) % {packing.SPREAD},
           (coalesce(doc_id, 0) >> 8) % {packing.SPREAD}, doc_id) AS nth
  FROM sized s JOIN bounds b ON s.n_tokens <= b.bucket_len AND s.n_tokens > b.above)
SELECT doc_id, n_tokens, bucket, bucket_len,
       ((nth - 1) // greatest(1, {packing.BUDGET} // greatest(1, bucket_len)))::BIGINT AS batch,
       bucket_len - n_tokens AS padding
FROM placed"""


PACKING = _packing()


def _quality() -> str:
    q = quality_rules
    share, level = q.RISK / len(q.RULES), q.ERROR / (len(q.RULES) * (len(q.BANDS) + 1))
    rate = "CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END"
    rates = {
        "symbols": rate.format(a="n_symbols", b="word_chars"),
        "dup_lines": rate.format(a="n_dup_lines", b="n_lines"),
        "repeats": rate.format(a="n_repeat_words", b="n_words"),
        "same_words": rate.format(a="(n_words - n_distinct)", b="n_words"),
        "capitals": rate.format(a="n_capitals", b="word_chars"),
        "exclamations": rate.format(a="n_exclamations", b="n_words"),
    }
    cells = " UNION ALL ".join(
        f"SELECT row_id, doc_id, band, base_failed, '{name}' AS rule, {expr} AS rate FROM banded"
        for name, expr in rates.items()
    )
    band = " + ".join(f"(n_words >= {limit})::INT" for limit in q.BANDS)
    return f"""
WITH numbered AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT row_id, i, w[i:i + {q.WINDOW - 1}] AS g
  FROM (SELECT row_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM numbered WHERE len(w) >= {q.WINDOW})),
twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM grams) WHERE n > 1),
reps AS (
  SELECT row_id, sum(least({q.WINDOW}, coalesce(nxt - i, {q.WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM twice) GROUP BY row_id),
counted AS (
  SELECT row_id, doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct,
         length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
         (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclamations,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM numbered),
banded AS (
  SELECT c.*, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, {band} AS band,
         n_words < {q.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counted c LEFT JOIN reps USING (row_id)),
cells AS MATERIALIZED ({cells}),
marks AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM cells JOIN marks USING (doc_id) WHERE NOT base_failed),
goods AS (SELECT band, count(*) AS n FROM held WHERE good AND rule = 'symbols' GROUP BY band),
hits AS (
  SELECT band, rule, cutoff, count(*) FILTER (good) AS k, count(*) FILTER (NOT good) AS bad
  FROM held JOIN (SELECT unnest({list(q.CUTOFFS)}) AS cutoff) c ON rate > cutoff GROUP BY ALL),
tested AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
              + i * ln({share!r}::DOUBLE) + (n - i) * ln(1 - {share!r}::DOUBLE)))) AS p
  FROM hits JOIN goods USING (band) WHERE k <= n * {share!r}::DOUBLE),
cuts AS (
  SELECT band, rule, arg_max(cutoff, (bad - {q.GOOD_WEIGHT} * k) * 1000 + cutoff) AS cutoff
  FROM tested WHERE p <= {level!r}::DOUBLE AND bad - {q.GOOD_WEIGHT} * k > 0 GROUP BY band, rule),
over AS (SELECT DISTINCT row_id FROM cells JOIN cuts USING (band, rule) WHERE rate > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND over.row_id IS NULL AS kept
FROM banded LEFT JOIN over USING (row_id)"""


QUALITY_RULES = _quality()

URL_FILTERS = """
WITH captures AS (
  SELECT page_id, url,
         DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 366)::INT AS fetched,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]$', '') AS host,
         regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+)', 1) AS step
  FROM pages),
met AS (
  SELECT page_id, url, fetched, 0 AS rank, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS pattern
  FROM captures WHERE regexp_extract(host, '([^.]+[.][^.]+)$', 1) <> ''
  UNION ALL SELECT page_id, url, fetched, 1, host FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched, 2, host || '/' || step FROM captures WHERE host <> '' AND step <> ''),
listed AS (
  SELECT *, ('0x' || h[2:3])::INT % 180 AS d, ('0x' || h[4:5])::INT % 90 AS gap, ('0x' || h[6])::INT % 2 = 0 AS again
  FROM (SELECT DISTINCT rank, pattern, md5(rank || '|' || pattern) AS h FROM met)
  WHERE ('0x' || h[1])::INT % CASE WHEN rank = 0 THEN 8 ELSE 2 END = 0),
entries AS (
  SELECT rank, pattern, max(action) AS action, day FROM (
    SELECT rank, pattern, 'block' AS action, DATE '2024-01-01' + d AS day FROM listed
    UNION ALL SELECT rank, pattern, 'allow', DATE '2024-01-01' + (d + gap + 1) FROM listed
    UNION ALL SELECT rank, pattern, 'block', DATE '2024-01-01' + (d + gap + 31) FROM listed WHERE again)
  GROUP BY rank, pattern, day),
valid AS (
  SELECT *, lead(day, 1, DATE '9999-12-01') OVER (PARTITION BY rank, pattern ORDER BY day) AS until FROM entries),
answers AS (
  SELECT page_id, arg_max(action, m.rank) AS action, arg_max(m.pattern, m.rank) AS pattern, arg_max(day, m.rank) AS since
  FROM met m JOIN valid v ON m.rank = v.rank AND m.pattern = v.pattern AND day <= fetched AND fetched < until
  GROUP BY page_id)
SELECT page_id, url, fetched, host, coalesce(action = 'block', false) AS blocked, pattern, since
FROM captures LEFT JOIN answers USING (page_id)"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
           FROM worded, range(1, {collocations.LONGEST} + 1) sizes(m) WHERE len(w) >= m),
known AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
          FROM placed GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE m > 1),
cuts AS (SELECT lang, phrase, w, f, unnest(range(1, m)) AS k FROM phrases),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, 1000 * c.f * t.n // (x.f * y.f) AS score, k
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, s, unnest(range(1, m - s + 2)) AS i
        FROM phrases, range(2, {collocations.LONGEST}) sizes(s) WHERE s < m)
  GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY rank <= {collocations.TOP}"""
