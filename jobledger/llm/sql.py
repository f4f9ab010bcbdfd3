"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in ``tests/llm``."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM split WHERE len(words) >= 13),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS w FROM starts),
least AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN least USING (w) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

# Times at which the integral of each of the three schedules (1.5, 1, 0.5), (1, 1, 1) and (0.5, 1, 1.5) reaches x.
DEMAND_TIME = """CASE source_rank % 3
    WHEN 0 THEN CASE WHEN x < 0.625::DOUBLE THEN 2 * x / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * x)) ELSE 0.5::DOUBLE + 2 * (x - 0.625::DOUBLE) / (1 + sqrt(1 - 2 * (x - 0.625::DOUBLE))) END
    WHEN 1 THEN x
    ELSE CASE WHEN x < 0.375::DOUBLE THEN 2 * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * x)) ELSE 0.5::DOUBLE + 2 * (x - 0.375::DOUBLE) / (1 + sqrt(1 + 2 * (x - 0.375::DOUBLE))) END END"""

CURRICULUM_MIX = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
ranked AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[source_rank % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM ranked),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, source_rank, CASE WHEN cap <= level * weight THEN cap
  ELSE weight * (SELECT arg_min(level, cap / weight * 1000000 + source_rank) FROM leveled WHERE cap > level * weight) END AS target FROM leveled),
placed AS (SELECT doc_id, size, source_size, source_rank, target, floor(target)::BIGINT AS wanted,
  sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS begin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, greatest(0, least(size, wanted - begin)) AS first, greatest(0, least(size, wanted - begin - source_size)) AS second, begin / target AS x FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target, first + second AS taken, CASE WHEN first > 0 THEN round({DEMAND_TIME}, 9) END AS first_position FROM taken
"""

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM split),
keyed AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> holder) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, w[p:p + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
windows AS (SELECT DISTINCT array_to_string(x, ' ') AS x, len(x) AS n, item_id FROM cut),
starts AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n)),
hits AS (SELECT doc_id, p, s.n, item_id FROM starts s JOIN windows v ON s.n = v.n AND s.x = v.x),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ROUNDS = 6


def _vector_codes() -> str:
    """Six rounds of assignment and replacement, written out one after the other."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """cut AS (SELECT vec_id, label, p, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM
  (SELECT vec_id, label, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS v FROM kept, (SELECT unnest(range(8)) AS p)))""",
        """book0 AS (SELECT p, e, i, c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, p, min(d * 16 + e) AS best FROM
  (SELECT vec_id, cut.p, e, sum((cut.c - b.c) * (cut.c - b.c))::BIGINT AS d FROM cut JOIN book{r} b ON cut.p = b.p AND cut.i = b.i GROUP BY vec_id, cut.p, e)
  GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(m, c) AS c FROM book{r} LEFT JOIN
  (SELECT p, CAST(best % 16 AS BIGINT) AS e, i, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS m FROM near{r} JOIN cut USING (vec_id, p) GROUP BY ALL) USING (p, e, i))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_DEDUP,
        "op3_curriculum_mix": CURRICULUM_MIX,
        "op4_line_dedup": LINE_DEDUP,
        "op7_decontaminate": DECONTAMINATE,
        "op12_vector_codes": _vector_codes(),
    }
