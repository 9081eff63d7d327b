"""SQL that the queries of this subpackage must agree with, where SQL can express them."""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, source_size, [1, 2, 3][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
prefixes AS (
  SELECT *, sum(source_size) OVER () AS total, 3.0::DOUBLE * source_size / weight AS stop,
         coalesce(sum(source_size * 3) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
  FROM ranked WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (
  SELECT coalesce(arg_min(CAST(total - held AS DOUBLE) / free, -free) FILTER (CAST(total - held AS DOUBLE) / free <= stop), 0) AS one FROM prefixes),
targets AS (
  SELECT source, source_size, least(weight * one, CAST(source_size * 3 AS DOUBLE)) AS target FROM ranked, share),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('42' || coalesce(':' || CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM rated"""

CASCADE_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, pos, words[pos] AS a, words[pos + 1] AS b, words[pos + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS pos FROM worded)),
twice AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (
  SELECT r, sum(least(3, coalesce(next - pos, 3))) AS n_repeat_words
  FROM (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS next FROM twice) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM worded) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 4 * n_words OR (n_dup_lines >= 5 AND 20 * n_dup_lines > n_words)
            OR 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars) AS kept
FROM measured"""
