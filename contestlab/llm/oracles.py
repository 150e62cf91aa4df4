"""SQL forms of the operators that SQL can express."""

from __future__ import annotations

from . import rules

TOP_K = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def quality_rules() -> str:
    """Measures by unnested windows, bounds by summing the binomial terms."""
    levels = " UNION ALL ".join(
        f"SELECT n, doc_id, stratum, base_failed, {i} AS rule, '{r.name}' AS name, {len(r.cutoffs)} AS steps, "
        + " + ".join(f"CASE WHEN {r.sign} * {r.num} >= CAST({r.sign * c!r} AS DOUBLE) * {r.den} THEN 1 ELSE 0 END" for c in r.cutoffs) + " AS level FROM m"
        for i, r in enumerate(rules.RULES))
    p, error = f"CAST({rules.RISK / len(rules.RULES)!r} AS DOUBLE)", rules.ERROR
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), places AS (
  SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, three) AS c FROM places) WHERE c > 1
), covered AS (
  SELECT n, count(DISTINCT i + j) AS c FROM twice, range(3) r(j) GROUP BY n
), m0 AS (
  SELECT d.n, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_bangs, CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN covered ON covered.n = d.n
), m AS MATERIALIZED (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM m0
), lv AS MATERIALIZED ({levels}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS MATERIALIZED (SELECT stratum, rule, steps, level FROM lv SEMI JOIN good ON good.doc_id = lv.doc_id WHERE NOT base_failed),
pairs AS (SELECT stratum, rule, steps, count(*) AS total FROM held GROUP BY ALL),
tested AS (SELECT stratum, rule, total, least, (SELECT count(*) FROM held h WHERE h.stratum = p.stratum AND h.rule = p.rule AND h.level >= least) AS k
  FROM (SELECT *, unnest(range(1, steps + 1)) AS least FROM pairs) p),
found AS (SELECT stratum, rule, min(least) AS least FROM tested WHERE k <= total * {p}
    AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({p}) + (total - i) * ln(1 - {p})))) <= {error} / (SELECT count(*) FROM pairs)
  GROUP BY ALL),
hits AS (SELECT n, string_agg(name, ',' ORDER BY lv.rule) AS names FROM lv JOIN found ON found.stratum = lv.stratum AND found.rule = lv.rule AND level >= least WHERE NOT base_failed GROUP BY n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bangs, n_capitals, base_failed, NOT base_failed AND names IS NULL AS kept,
  CASE WHEN base_failed THEN 'base' ELSE coalesce(names, '') END AS rejected_by, stratum
FROM m LEFT JOIN hits ON hits.n = m.n
"""


#: CRC-32 byte by byte over a table made from its polynomial; positions are running sums.
SHARDS = """
WITH t AS MATERIALIZED (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) r(b)
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, CAST(len(h) // 2 + 8 AS BIGINT) AS size, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS bytes FROM d
), c AS MATERIALIZED (
  SELECT doc_id, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t
), p AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS whole FROM c WINDOW w AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, CAST((2 * before + size) * 24 // (2 * whole) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


#: All phrases of up to five words counted one by one; cuts and containments by joins on their texts.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
), starts AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) r(k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100
), c AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, h.a AS l, t.a AS r, n, h.k AS cut, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.p[1:j], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.p[j + 1:], ' ') JOIN totals ON totals.lang = c.lang
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a AS longer, array_to_string(p[i : j], ' ') AS phrase FROM c, range(1, 6) x(i), range(1, 6) y(j) WHERE i < j AND j <= k AND j - i + 1 < k) u
  JOIN c s ON s.lang = u.lang AND s.phrase = u.phrase AND 100 * longer >= 100 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

#: Every document walks every order: a step removes what fails its filter and none before it.
FILTER_AUDIT = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, coalesce(doc_id, -9223372036854775808) AS rid,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(rid) OVER (PARTITION BY t) < rid THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l USING (doc_id)
), cells AS MATERIALIZED (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), steps AS MATERIALIZED (
  SELECT o AS filter_order, s AS step, o[s] AS letter, o[1 : s - 1] AS before, o[1 : s] AS upto
  FROM (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e), range(1, 6) r(s)
  WHERE contains(o, 'A') AND contains(o, 'B') AND contains(o, 'C') AND contains(o, 'D') AND contains(o, 'E')
), walked AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (translate(f, upto, '') = f), 0) AS kept, coalesce(sum(n) FILTER (contains(f, letter) AND translate(f, before, '') = f), 0) AS removed,
    coalesce(sum(n) FILTER (contains(f, letter) AND translate(f, before, '') <> f), 0) AS redundant, coalesce(sum(n) FILTER (f = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(f, letter) AND translate(f, before, '') = f), 0) AS good_lost, coalesce(sum(toxic) FILTER (contains(f, letter) AND translate(f, before, '') = f), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM walked
"""
