"""DuckDB SQL for the queries that SQL can express, written from their contracts.

The base columns and the thresholds are the contract's and the rule table's;
windows are compared as lists of words, shingle sets as rows.
"""

from __future__ import annotations

from reportlake.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, rules_sql

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _texts(text: str = "coalesce(text, '')") -> str:
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, {text} AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format(t="t")} AS words FROM d)"""


def _windows(size: int) -> str:
    return f"""win AS (SELECT rid, i, list_slice(words, i, i + {size - 1}) AS k
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - {size - 2}, 1))) AS i FROM w))"""


def quality_rules_sql() -> str:
    stop = ", ".join("'" + x + "'" for x in sorted({x for s in STOP_WORDS.values() for x in s.split()}))
    return f"""WITH {_texts()},
{_windows(8)},
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM dup) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, len(words) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[!?]')) AS n_marks,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop
  FROM w JOIN l USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, coalesce(100.0 * n_repeat_words / nullif(n_words, 0), 0) AS repeat_percent,
    coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0), 0) AS mean_word_chars,
    coalesce(CAST(n_symbols AS DOUBLE) / nullif(n_words, 0), 0) AS symbol_ratio,
    coalesce(CAST(n_marks AS DOUBLE) / nullif(n_words, 0), 0) AS mark_ratio,
    coalesce(CAST(n_stop AS DOUBLE) / nullif(n_words, 0), 0) AS stop_ratio,
    coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS dup_line_ratio FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT ({rules_sql((*BASE_RULES, *RULES))}) AS kept FROM r"""


def near_dedup_sql(words: int = 2) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return f"""WITH RECURSIVE {_texts(lowered)},
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + {words - 1}) AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {words - 2}, 2))) AS i FROM w
        WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY ALL),
link AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT e.u, reach.r FROM reach JOIN edge e ON e.v = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)"""


def substring_dedup_sql(window: int = 35) -> str:
    return f"""WITH {_texts()},
{_windows(window)},
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c >= 2),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {window})) AS pos FROM dup),
each AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS k FROM each ANTI JOIN gone USING (rid, pos) GROUP BY rid),
cnt AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid) LEFT JOIN cnt USING (rid)"""


def hard_negatives_sql() -> str:
    return """WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.y = b.y AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT a, id AS positive_id, score AS ps, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k
  FROM s WHERE same QUALIFY k <= 5),
f AS (SELECT p.a, k, positive_id, ps, anchor_id, id, score,
    row_number() OVER (PARTITION BY p.a, k ORDER BY score DESC, id) AS r
  FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps QUALIFY r <= 10)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, id AS negative_id, ps AS positive_score,
  score AS negative_score FROM f"""


def oracles() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules_sql(), "op5_near_dedup": near_dedup_sql(),
            "op10_substring_dedup": substring_dedup_sql(), "op11_hard_negatives": hard_negatives_sql()}
