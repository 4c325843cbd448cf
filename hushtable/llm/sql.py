"""The results of the operators as DuckDB SQL, where SQL can state them."""

from hushtable.llm.quality_rules import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = {}

ORACLE["op5_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS bangs,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    greatest(len(w), 1) AS nw, greatest(len(l), 1) AS nl,
    len(list_filter(w, lambda x: lower(x) IN ({STOPS}))) AS stops,
    len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS alphas,
    len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS dots,
    len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS bullets
  FROM d LEFT JOIN covered c USING (doc_id)),
j AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    list_filter([
      CASE WHEN NOT (word_chars / nw BETWEEN 2.0 AND 14.0) THEN 'mean_word_chars' END,
      CASE WHEN NOT (n_symbols / nw <= 0.2) THEN 'symbol_ratio' END,
      CASE WHEN NOT (stops >= 1) THEN 'stop_words' END,
      CASE WHEN NOT (dots / nl <= 0.3) THEN 'ellipsis_lines' END,
      CASE WHEN NOT (bullets / nl <= 0.9) THEN 'bullet_lines' END,
      CASE WHEN NOT (n_dup_lines / nl <= 0.3) THEN 'duplicate_lines' END,
      CASE WHEN NOT (alphas / nw >= 0.6) THEN 'alphabetic_words' END,
      CASE WHEN NOT (bangs / nw <= 0.5) THEN 'exclamations' END], lambda x: x IS NOT NULL) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND len(failed) = 0) AS kept, array_to_string(failed, ',') AS failed
FROM j
"""

ORACLE["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::UINTEGER::BIGINT AS h1, ('0x' || h[9:16])::UINTEGER::BIGINT AS h2, ('0x' || h[17:24])::UINTEGER::BIGINT AS h3, ('0x' || h[25:32])::UINTEGER::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLE["op12_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= 10),
parts AS (SELECT lang, k, g, f AS a, cut, g[1:cut] AS head, g[cut + 1:k] AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
cuts AS (
  SELECT p.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts AS p JOIN f AS x ON x.lang = p.lang AND x.g = p.head JOIN f AS y ON y.lang = p.lang AND y.g = p.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, g) WHERE k = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
