"""SQL equivalents of the registered queries, for DuckDB."""

from __future__ import annotations

from .config import SUFFIXES
from .operators.evaluation import COMMON_WORDS, HISTORY_WORDS, INFORMAL_MARKS
from .operators.review import OUTSIDE, VAGUE
from .queries import MIX, T

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)

NAMES = r"""names AS (
  SELECT min(p_partkey) AS ord, name FROM (
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')
           || ['', ' Inc.', ' Corp', ', LLC', ' Company'][(p_size % 5 + 1)::INT] AS name FROM part) GROUP BY name)"""
NORMED = NAMES + rf""", plained AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM names
), stripped AS (
  SELECT *, array_to_string(list_filter(string_split(plain, ' '), lambda w: w NOT IN ({_LIST(SUFFIXES)})), ' ') AS short FROM plained
), normed AS (SELECT ord, name, plain, CASE WHEN short = '' THEN plain ELSE short END AS norm FROM stripped)"""
GROUPED = NORMED + """, grouped AS (
  SELECT ord, name, norm, (dense_rank() OVER (ORDER BY first) - 1)::INT AS group_id FROM (SELECT *, min(ord) OVER (PARTITION BY norm) AS first FROM normed))"""
CANON = GROUPED + r""", best AS (
  SELECT group_id, name AS canonical_name, ord AS canonical_ord FROM grouped
  QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY length(name), len(string_split(name, ' ')), -length(regexp_replace(name, '[^\p{Lu}]', '', 'g')), ord) = 1)"""
KEYED = NORMED + """, keyed AS (SELECT ord, name, coalesce(list_filter(string_split(plain, ' '), lambda w: w NOT IN ('the', 'a', 'an') AND w <> '')[1], '') AS block_key FROM normed)"""
SIZED = KEYED + """, sized AS (
  SELECT block_key, count(*) AS n, min(ord) AS first_ord, (count(*) * (count(*) - 1) // 2)::BIGINT AS all_pairs FROM keyed WHERE block_key <> '' GROUP BY block_key)"""
SIMS = """v AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e, label FROM embeddings),
sims AS (SELECT a.ord AS a_ord, b.ord AS b_ord, greatest(0, least(1, list_cosine_similarity(a.e, b.e))) AS score FROM v a JOIN v b ON a.ord < b.ord)"""
LABELLED = """v AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e, label FROM embeddings),
labelled AS (SELECT ord, 'v' || ord AS name, label AS truth, (list_position(e[1:8], list_max(e[1:8])) - 1)::INT AS group_id FROM v)"""
SCORES = """s AS (
  SELECT o_orderkey AS id, ((o_orderkey * 7919) % 1001)::DOUBLE / 1000 AS score, o_orderkey % 3 = 0 AS agree, ((o_orderkey * 31) % 101)::DOUBLE / 100 AS certainty,
         ['same', 'different', 'unknown'][(o_orderkey % 3 + 1)::INT] AS decision FROM orders)"""
POSTERIOR = "1 / (1 + exp(-greatest(-700, least(700, {0!r} * score * score + {1!r} * score + {2!r}))))".format(*MIX.log_odds())
PENALTY = f"CASE WHEN score >= {T.t_high} THEN 0 WHEN score <= {T.s_90} THEN 10 ELSE 10.0 * ({T.t_high} - score) / ({T.t_high}::DOUBLE - {T.s_90}) END"
PAIRED = NORMED + """, paired AS (
  SELECT a.ord AS a_ord, b.ord AS b_ord, a.name AS a, b.name AS b, a.norm AS a_norm, b.norm AS b_norm, string_split(a.norm, ' ') AS x, string_split(b.norm, ' ') AS y,
         (a.ord % 101)::DOUBLE AS wratio, (b.ord % 101)::DOUBLE AS token_set, (a.ord % 91)::DOUBLE AS embedding, (b.ord % 100)::DOUBLE / 100 AS score
  FROM normed a JOIN normed b ON string_split(a.norm, ' ')[1] = string_split(b.norm, ' ')[1] AND a.ord < b.ord)"""
_SUBSET = "(len(list_filter(x, lambda w: NOT list_contains(y, w))) = 0 OR len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0)"
_SHARED = "list_distinct(list_intersect(x, y))"
_EITHER = lambda words: "(" + " OR ".join(f"contains(a_norm, '{w}') OR contains(b_norm, '{w}')" for w in words) + ")"
_SHORT = r"(length({0}) <= 5 AND NOT contains({0}, ' ') AND {0} = upper({0}) AND regexp_matches({0}, '\p{{Lu}}'))"
_VAGUE = "CASE " + " ".join(f"WHEN contains(lower(said), '{p}') THEN '{p}'" for p in VAGUE) + " END"
_OUTSIDE = "(" + " OR ".join(f"contains(lower(said), '{p}')" for p in OUTSIDE) + ")"


def _weak(a: str, b: str) -> str:
    long = "list_distinct(list_filter(regexp_split_to_array(trim(lower({0})), '\\s+'), lambda w: length(w) > 2))"
    words = "regexp_split_to_array(trim(lower(said)), '\\s+')"
    x, y = long.format(a), long.format(b)
    unsaid = lambda z: f"(len({z}) > 0 AND len(list_intersect({z}, {words})) = 0)"
    shared = f"list_intersect({x}, {y})"
    return f"""CASE WHEN length(said) < 30 THEN 'Reasoning too short (< 30 chars)'
      WHEN {_VAGUE} IS NOT NULL THEN 'Generic/uncertain phrase detected: ''' || {_VAGUE} || ''''
      WHEN CASE WHEN len({shared}) > 0 THEN {unsaid(shared)} ELSE {unsaid(x)} OR {unsaid(y)} END THEN 'Reasoning doesn''t reference the actual names' END"""


ANSWERS = SCORES + f""", q AS (
  SELECT id, 'alpha' || id % 7 || ' corp' AS a, 'alpha' || id % 7 || ' ag' AS b, score AS similarity, CASE WHEN id % 11 <> 0 THEN decision END AS decision, certainty AS confidence,
         CASE WHEN id % 5 = 0 THEN 'short' ELSE 'alpha' || id % 7 || ' corp and alpha' || id % 7 || ' share their first word' END AS said FROM s
), g AS (
  SELECT *, CASE WHEN decision IS NULL THEN 'Invalid response structure: missing required fields'
    WHEN {_OUTSIDE} THEN 'Possible hallucination detected in reasoning'
    WHEN {_weak("a", "b")} IS NOT NULL THEN 'Weak reasoning: ' || {_weak("a", "b")}
    WHEN decision <> 'unknown' AND confidence < 0.6 THEN 'Confidence ' || printf('%.2f', confidence) || ' below threshold 0.6' END AS why FROM q
), f AS (
  SELECT id, similarity, CASE WHEN why IS NULL THEN decision ELSE 'unknown' END AS decision, CASE WHEN decision IS NULL THEN 0 ELSE confidence END AS llm_confidence,
         why IS NOT NULL AS guardrails_triggered, why AS guardrail_reason, coalesce(decision <> 'unknown' AND confidence < 0.6, false) AS low_confidence FROM g
), adj AS (
  SELECT *, greatest(0, least(1, similarity + 0.15 * CASE decision WHEN 'same' THEN 1 WHEN 'different' THEN -1 ELSE 0 END * llm_confidence)) AS adjusted FROM f)"""
_RATES = """counted AS (SELECT tp, p - tp AS fp, t - tp AS fn, m * (m - 1) // 2 - p - t + tp AS tn FROM c), rated AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re FROM counted)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall,
       round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM rated"""
_LCS = """WITH RECURSIVE p AS (SELECT s_suppkey AS a, lower(s_name) AS x, n_nationkey AS b, lower(n_name) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (
  SELECT a, b, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda k: 0) AS row FROM p
  UNION ALL
  SELECT a, b, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, k: list_append(acc, CASE WHEN x[i + 1:i + 1] = y[k:k] THEN row[k] + 1 ELSE greatest(acc[len(acc)], row[k + 1]) END), [0::BIGINT])
  FROM t WHERE i < length(x))
SELECT a, b, round(200.0 * row[len(row)] / (length(x) + length(y)), 6) AS ratio FROM t WHERE i = length(x)"""

SQL = {
    "extract": "SELECT min(p_partkey) AS ord, p_name AS name FROM part GROUP BY p_name",
    "normalize": f"WITH {NORMED} SELECT ord, name, norm FROM normed",
    "fold": "SELECT doc_id, lower(strip_accents(replace(text, 'ß', 'ss'))) AS folded FROM documents",
    "blocking_token": f"""WITH {NORMED}, e AS (
      SELECT ord, plain AS form FROM normed UNION ALL SELECT s_suppkey + 1000000000, trim(regexp_replace(regexp_replace(lower('The ' || s_name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) FROM supplier
    ), k AS (SELECT *, coalesce(list_filter(string_split(form, ' '), lambda w: w NOT IN ('the', 'a', 'an') AND w <> '')[1], '') AS token FROM e)
    SELECT *, length(token) > 2 AND NOT regexp_matches(token, '[0-9]') AS blockable, length(token) > 1 AND NOT regexp_matches(token, '[0-9]') AS encodable FROM k""",
    "name_shape": rf"WITH {NAMES} SELECT ord, length(name)::INT AS length, len(string_split(name, ' '))::INT AS words, length(regexp_replace(name, '[^\p{{Lu}}]', '', 'g'))::INT AS capitals FROM names",
    "norm_groups": f"WITH {GROUPED} SELECT ord, name, group_id FROM grouped",
    "canonical": f"WITH {CANON} SELECT group_id, canonical_name FROM best",
    "mappings": f"""WITH {CANON} SELECT g.ord, g.name, canonical_name, group_id, CASE WHEN g.ord = canonical_ord THEN coalesce(others, '') ELSE concat_ws('|', canonical_name, others) END AS alternatives
    FROM grouped g JOIN best USING (group_id) LEFT JOIN (SELECT group_id, string_agg(o.name, '|' ORDER BY o.ord) AS others FROM grouped o JOIN best USING (group_id) WHERE o.ord <> canonical_ord GROUP BY group_id) USING (group_id)""",
    "audit": f"WITH {CANON} SELECT g.ord, CASE WHEN name = canonical_name THEN 'Selected as canonical name' ELSE 'Matched to ''' || canonical_name || ''' with 100.00% confidence' END AS reasoning, 'HIGH' AS level FROM grouped g JOIN best USING (group_id)",
    "summary": f"WITH {GROUPED} SELECT count(*) AS total_input_names, count(DISTINCT group_id) AS total_groups_created, round((1 - count(DISTINCT group_id) / count(*)) * 100, 6) AS reduction_percentage, round(count(*) / count(DISTINCT group_id), 6) AS average_group_size FROM grouped",
    "group_sizes": f"WITH {GROUPED} SELECT count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n BETWEEN 2 AND 5) AS small, count(*) FILTER (n >= 6) AS large, max(n) AS largest FROM (SELECT count(*) AS n FROM grouped GROUP BY group_id)",
    "blocks": f"WITH {SIZED} SELECT block_key, n, first_ord, all_pairs, least(all_pairs, 20) AS n_pairs, all_pairs > 20 AS capped FROM sized WHERE n >= 2",
    "block_summary": f"""WITH {SIZED} SELECT sum(n)::BIGINT AS total_names, count(*) AS total_keys, count(*) FILTER (n >= 2) AS total_blocks, coalesce(sum(n) FILTER (n < 2), 0)::BIGINT AS singletons_filtered,
      max(n) FILTER (n >= 2) AS largest_block_size, arg_max(block_key, (n, -first_ord)) FILTER (n >= 2) AS largest_block, max(all_pairs) FILTER (n >= 2) AS largest_block_pairs,
      count(*) FILTER (n >= 2 AND all_pairs > 20) AS blocks_capped, coalesce(sum(least(all_pairs, 20)) FILTER (n >= 2), 0)::BIGINT AS within_block_pairs FROM sized""",
    "allocation": f"""WITH {SIZED}, b AS (SELECT block_key, first_ord, least(all_pairs, 200) AS n_pairs FROM sized WHERE n >= 2), t AS (SELECT sum(n_pairs) AS p, count(*) AS k FROM b),
      c AS (SELECT b.*, p, k, floor(80.0 * (n_pairs / p::DOUBLE))::BIGINT + 20 // k AS base, row_number() OVER (ORDER BY n_pairs DESC, first_ord) AS rn FROM b, t), r AS (SELECT *, greatest(100 - sum(base) OVER (), 0)::BIGINT AS rest FROM c)
      SELECT block_key, n_pairs, CASE WHEN p <= 100 THEN n_pairs ELSE least(base + rest // k + (rn <= rest % k)::INT, n_pairs) END AS allocated FROM r""",
    "within": f"WITH {KEYED} SELECT block_key, a.ord AS a_ord, b.ord AS b_ord FROM keyed a JOIN keyed b USING (block_key) WHERE a.ord < b.ord AND block_key <> ''",
    "capped": f"""WITH {KEYED} SELECT * FROM (SELECT block_key, a.ord AS a_ord, b.ord AS b_ord, row_number() OVER (PARTITION BY block_key ORDER BY a.ord, b.ord) AS pair_no
      FROM keyed a JOIN keyed b USING (block_key) WHERE a.ord < b.ord AND block_key <> '') WHERE pair_no <= 20""",
    "cosine": f"WITH {SIMS} SELECT a_ord, b_ord, round(score, 5) AS score FROM sims WHERE score >= 0.35",
    "cosine_topk": f"WITH {SIMS} SELECT a_ord, b_ord, round(score, 5) AS score FROM sims WHERE score >= 0.3 ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "edges": f"WITH {SIMS} SELECT a_ord AS a, b_ord AS b FROM sims WHERE score >= 0.4",
    "borderline": f"WITH {SIMS} SELECT a_ord, b_ord FROM sims WHERE score >= 0.3 AND round(1 - score, 12) BETWEEN 0.5 AND 0.65",
    "components": f"""WITH RECURSIVE {SIMS}, e AS (SELECT a_ord AS a, b_ord AS b FROM sims WHERE score >= 0.45 UNION SELECT b_ord, a_ord FROM sims WHERE score >= 0.45),
      r AS (SELECT ord AS a, ord AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a) SELECT a AS ord, min(c) AS component FROM r GROUP BY a""",
    "leaders": f"""WITH RECURSIVE {SIMS}, e AS (SELECT a_ord AS a, list(b_ord) AS bs FROM sims WHERE score >= 0.4 GROUP BY a_ord),
      o AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k FROM v), step AS (
        SELECT 0::BIGINT AS k, MAP([]::BIGINT[], []::BIGINT[]) AS done
        UNION ALL
        SELECT step.k + 1, CASE WHEN map_contains(done, o.ord) THEN done ELSE map_concat(map_from_entries(list_transform(list_append(list_filter(coalesce(bs, []), lambda z: NOT map_contains(done, z)), o.ord), lambda z: ROW(z, o.ord))), done) END
        FROM step JOIN o ON o.k = step.k + 1 LEFT JOIN e ON e.a = o.ord)
      SELECT unnest(map_keys(done)) AS ord, unnest(map_values(done)) AS leader FROM (SELECT done FROM step ORDER BY k DESC LIMIT 1)""",
    "hac_single": f"""WITH RECURSIVE {SIMS}, e AS (SELECT a_ord AS a, b_ord AS b FROM sims WHERE score >= 0.45 UNION SELECT b_ord, a_ord FROM sims WHERE score >= 0.45),
      r AS (SELECT ord AS a, ord AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a), m AS (SELECT a AS ord, min(c) AS c FROM r GROUP BY a) SELECT ord, (dense_rank() OVER (ORDER BY c) - 1)::INT AS group_id FROM m""",
    "hac_distances": f"""WITH {LABELLED}, z AS (SELECT group_id, count(*) AS n FROM labelled GROUP BY ALL),
      d AS (SELECT 1 - greatest(0, least(1, list_cosine_similarity(a.e, b.e))) AS d, x.group_id = y.group_id AS same FROM v a JOIN v b ON a.ord < b.ord JOIN labelled x ON x.ord = a.ord JOIN labelled y ON y.ord = b.ord)
      SELECT sum(n)::BIGINT AS total_names, count(*) AS total_clusters, max(n) AS max_cluster_size, count(*) FILTER (n = 1) AS singleton_clusters, round(avg(n), 5) AS avg_cluster_size,
      round((1 - count(*) / sum(n)) * 100, 5) AS reduction_percentage, (SELECT round(avg(d), 5) FROM d) AS avg_distance_all_pairs, (SELECT round(avg(d), 5) FROM d WHERE same) AS avg_distance_within_clusters FROM z""",
    "percentiles": f"""WITH {SIMS}, p AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75, 0.9]) AS p FROM sims)
      SELECT round(p[1], 5) AS p25, round(p[2], 5) AS p50, round(p[3], 5) AS p75, round(p[4], 5) AS p90, round(p[1], 5) AS reduce_50, round(p[2], 5) AS reduce_30, round(p[3], 5) AS reduce_15, round(p[4], 5) AS reduce_05, round(p[3], 5) AS default_threshold FROM p""",
    "indel": _LCS,
    "word_overlap": f"""WITH {PAIRED}, l AS (SELECT a_ord, b_ord, list_distinct(x) AS x, list_distinct(y) AS y FROM paired)
      SELECT a_ord, b_ord, round(len({_SHARED}) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS jaccard, len({_SHARED})::INT AS shared, {_SUBSET} AS subset FROM l""",
    "zone": f"""WITH {SCORES} SELECT id, score >= {T.t_high} OR (score >= {T.s_90} AND agree) AS same, CASE WHEN score >= {T.t_high} THEN 'accept' WHEN score >= {T.s_90} AND agree THEN 'promote'
      WHEN score >= {T.t_low} THEN 'review' ELSE 'reject' END AS zone, CASE WHEN score >= 0.85 THEN 'WOULD_MATCH' WHEN score >= 0.75 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END AS risk FROM s""",
    "penalty": f"WITH {SCORES} SELECT id, round({PENALTY}, 6)::DOUBLE AS penalty FROM s",
    "posterior": f"WITH {SCORES} SELECT id, round({POSTERIOR}, 6) AS posterior FROM s",
    "adjusted": f"""WITH {SCORES}, p AS (SELECT *, {POSTERIOR} AS p, {PENALTY} AS penalty FROM s) SELECT id, round(CASE WHEN score >= {T.t_high} THEN least((100 * p + CASE WHEN agree THEN 4 ELSE 0 END) / 100, 1)
      WHEN score >= {T.s_90} AND agree THEN least(100 * p + 4 - penalty, 89) / 100 ELSE p END, 6) AS confidence FROM p""",
    "review_adjust": f"WITH {SCORES} SELECT id, round(greatest(0, least(1, score + 0.15 * CASE decision WHEN 'same' THEN 1 WHEN 'different' THEN -1 ELSE 0 END * certainty)), 6)::DOUBLE AS similarity FROM s",
    "weighted": f"""WITH {SCORES} SELECT id, round(CASE WHEN id % 50 = 0 THEN 1.0::DOUBLE ELSE greatest(0, least(100, 0.4::DOUBLE * (100 * score) + 0.15::DOUBLE * (100 - 100 * score) + 0.45::DOUBLE * CASE WHEN agree THEN 100 * score ELSE 0 END
      + CASE WHEN agree THEN 4 ELSE -2 END)) / 100 END, 6) AS score FROM s""",
    "distance_threshold": f"WITH {SCORES}, x AS (SELECT id, CASE WHEN agree THEN score * 100 ELSE score END AS x FROM s) SELECT id, round(1 - CASE WHEN x > 1 THEN x / 100 ELSE x END, 6) AS distance FROM x",
    "formatters": f"WITH {SCORES} SELECT id, printf('%.1f', score * 100) || '%' AS percent, format('{{:,}}', id) AS thousands FROM s",
    "guardrails": rf"""WITH c AS (SELECT conv_id, turn, coalesce(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')[1], '') AS a, coalesce(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')[2], '') AS b,
      CASE WHEN turn % 3 = 0 THEN 'I think so ' || text WHEN turn % 3 = 1 THEN text || ' operates in sales' ELSE text END AS said FROM conversations)
      SELECT conv_id, turn, {_VAGUE} AS vague, {_OUTSIDE} AS outside, {_weak("a", "b")} AS weak FROM c""",
    "guard": f"WITH {ANSWERS} SELECT id, decision, llm_confidence, guardrails_triggered, guardrail_reason, low_confidence, round(adjusted, 6)::DOUBLE AS adjusted_similarity FROM adj",
    "review_stats": f"""WITH {ANSWERS} SELECT count(*) AS total_assessments, count(*) FILTER (guardrails_triggered) AS guardrails_triggered, count(*) FILTER (decision = 'unknown') AS unknown, count(*) FILTER (decision = 'same') AS same,
      count(*) FILTER (decision = 'different') AS different, round(avg(llm_confidence), 5) AS avg_confidence, count(*) FILTER (low_confidence) AS low_confidence_converted,
      count(*) FILTER (abs(adjusted - similarity) > 0.001) AS adjustments_applied, count(*) FILTER (id % 2 = 0) AS cache_hits, round(count(*) FILTER (id % 2 <> 0) * 0.0002, 5)::DOUBLE AS cost_estimate FROM adj""",
    "assess": f"""WITH {NORMED}, n AS (SELECT DISTINCT norm, string_split(norm, ' ')[1] AS k FROM normed) SELECT a.norm AS a, b.norm AS b, 'same' AS decision, round(0.6 + 0.15 * 0.9, 6)::DOUBLE AS adjusted_similarity FROM n a JOIN n b USING (k) WHERE a.norm < b.norm""",
    "purity": f"WITH {LABELLED}, c AS (SELECT group_id, truth, count(*) AS n FROM labelled GROUP BY ALL), g AS (SELECT group_id, max(n) / sum(n)::DOUBLE AS p FROM c GROUP BY group_id) SELECT round(avg(p), 6) AS purity FROM g",
    "completeness": f"WITH {LABELLED}, c AS (SELECT group_id, truth, count(*) AS n FROM labelled GROUP BY ALL), g AS (SELECT truth, max(n) / sum(n)::DOUBLE AS p FROM c GROUP BY truth) SELECT round(avg(p), 6) AS completeness FROM g",
    "confusion": f"""WITH {LABELLED}, c AS (SELECT count(*) FILTER (a.truth = b.truth AND a.group_id = b.group_id) AS tp, count(*) FILTER (a.group_id = b.group_id) AS p, count(*) FILTER (a.truth = b.truth) AS t,
      (SELECT count(*) FROM labelled) AS m FROM labelled a JOIN labelled b ON a.ord < b.ord), {_RATES}""",
    "pair_sets": f"""WITH {LABELLED}, l AS (SELECT ord, group_id, CASE WHEN ord % 10 <> 0 THEN truth END AS truth, truth AS whole FROM labelled), c AS (SELECT count(*) FILTER (a.truth = b.truth AND a.group_id = b.group_id) AS tp,
      count(*) FILTER (a.group_id = b.group_id) AS p, count(*) FILTER (a.whole = b.whole) AS t, (SELECT count(*) FROM labelled) AS m FROM l a JOIN l b ON a.ord < b.ord), {_RATES}""",
    "mixed_groups": f"WITH {LABELLED} SELECT group_id, count(*) AS members, count(DISTINCT truth) AS truths FROM labelled GROUP BY group_id HAVING count(*) > 1 AND count(DISTINCT truth) > 1",
    "false_pairs": f"WITH {LABELLED} SELECT a.group_id, count(*) AS n FROM labelled a JOIN labelled b ON a.group_id = b.group_id AND a.ord < b.ord AND a.truth <> b.truth GROUP BY ALL",
    "missed_pairs": f"WITH {LABELLED} SELECT a.truth, count(*) AS n FROM labelled a JOIN labelled b ON a.truth = b.truth AND a.ord < b.ord AND a.group_id <> b.group_id GROUP BY ALL",
    "category_counts": rf"""WITH {PAIRED}, t AS (SELECT [CASE WHEN least(length(a_norm), length(b_norm)) / greatest(length(a_norm), length(b_norm))::DOUBLE < 0.5 THEN 'ABBREVIATION' END,
      CASE WHEN {_SHORT.format('a_norm')} OR {_SHORT.format('b_norm')} THEN 'ACRONYM' END, CASE WHEN wratio > 70 AND score * 100 < 50 THEN 'TYPO' END,
      CASE WHEN len({_SHARED}) / len(list_distinct(list_concat(x, y)))::DOUBLE > 0.6 AND token_set > 70 THEN 'WORD_ORDER' END, CASE WHEN {_SUBSET} THEN 'PARTIAL_NAME' END,
      CASE WHEN {_EITHER(HISTORY_WORDS)} THEN 'HISTORICAL' END, CASE WHEN embedding < 40 THEN 'LOW_SEMANTIC' END, CASE WHEN (NOT contains(a_norm, ' ') OR NOT contains(b_norm, ' ')) AND {_EITHER(INFORMAL_MARKS)} THEN 'NICKNAME' END,
      CASE WHEN regexp_matches(a || b, '[^\x00-\x7F]') THEN 'TRANSLITERATION' END,
      CASE WHEN len(list_intersect({_SHARED}, [{_LIST(COMMON_WORDS)}])) > 0 AND NOT {_SUBSET} THEN 'COMMON_WORD_COLLISION' END] AS tags FROM paired),
      u AS (SELECT list_filter(tags, lambda z: z IS NOT NULL) AS tags FROM t), w AS (SELECT unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['OTHER'] END) AS category FROM u)
      SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM paired)::DOUBLE, 6) AS share FROM w GROUP BY category""",
    "shared_words": f"WITH {PAIRED}, w AS (SELECT unnest({_SHARED}) AS word FROM paired) SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 GROUP BY word ORDER BY n DESC, word LIMIT 10",
    "patterns": f"""WITH {PAIRED}, p AS (SELECT *, 0.4::DOUBLE * wratio AS w, 0.15::DOUBLE * token_set AS t, 0.45::DOUBLE * embedding AS e FROM paired) SELECT count(*) AS n, round(avg((len({_SHARED}) > 0)::INT), 5) AS share_shared_word,
      round(avg(({_SUBSET})::INT), 5) AS share_subset, round(avg(wratio), 5) AS avg_wratio, round(avg(token_set), 5) AS avg_token_set, round(avg(embedding), 5) AS avg_embedding, count(*) FILTER (w = greatest(w, t, e)) AS dominant_wratio,
      count(*) FILTER (t = greatest(w, t, e)) AS dominant_token_set, count(*) FILTER (e = greatest(w, t, e)) AS dominant_embedding, round(min(score), 5) AS min_score, round(max(score), 5) AS max_score FROM p""",
    "risky": f"""WITH c AS (SELECT ['American ', 'United ', 'First ', 'Blue '][(c_custkey % 4 + 1)::INT] || c_nationkey AS canonical_name, c_name AS name, c_custkey AS ord FROM customer),
      e AS (SELECT canonical_name, arg_min(name, ord) AS f, arg_max(name, ord) AS l FROM c GROUP BY canonical_name), h AS (SELECT e.*, word FROM e, (SELECT unnest([{_LIST(COMMON_WORDS)}]) AS word) WHERE contains(lower(canonical_name), word)),
      p AS (SELECT a.f AS a, b.l AS b FROM h a JOIN h b USING (word) WHERE a.canonical_name < b.canonical_name) SELECT DISTINCT ON (least(lower(a), lower(b)), greatest(lower(a), lower(b))) a, b FROM p ORDER BY least(lower(a), lower(b)), greatest(lower(a), lower(b)), a, b""",
    "histogram": f"""WITH {SCORES} SELECT CASE WHEN score >= 0.999 THEN '>=0.999' WHEN score >= 0.95 THEN '>=0.950' WHEN score >= 0.9 THEN '>=0.900' WHEN score >= 0.85 THEN '>=0.850' WHEN score >= 0.8 THEN '>=0.800'
      WHEN score >= 0.7 THEN '>=0.700' WHEN score >= 0.6 THEN '>=0.600' ELSE '<0.600' END AS bin, count(*) AS n FROM s GROUP BY ALL""",
    "three_bins": f"WITH {SCORES} SELECT count(*) FILTER (score >= 0.9) AS high, count(*) FILTER (score >= 0.7 AND score < 0.9) AS middle, count(*) FILTER (score < 0.7) AS low, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean FROM s",
    "spread": f"""WITH {SCORES} SELECT (id % 400)::INT AS group_id, count(*) AS n, round(max(score) - min(score), 6) AS spread FROM s GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, spread DESC, group_id LIMIT 25""",
    "text_filter": f"WITH {NAMES} SELECT ord, name FROM names WHERE contains(lower(name), 'an')",
    "set_operations": f"""WITH {LABELLED}, l AS (SELECT * FROM labelled), p AS (SELECT a.ord AS a, b.ord AS b FROM l a JOIN l b ON a.group_id = b.group_id AND a.ord < b.ord), t AS (SELECT a.ord AS a, b.ord AS b FROM l a JOIN l b ON a.truth = b.truth AND a.ord < b.ord)
      SELECT 'both' AS kind, count(*) AS n FROM (FROM p INTERSECT FROM t) UNION ALL SELECT 'only_predicted', count(*) FROM (FROM p EXCEPT FROM t) UNION ALL SELECT 'only_true', count(*) FROM (FROM t EXCEPT FROM p) UNION ALL SELECT 'either', count(*) FROM (FROM p UNION FROM t)""",
    "json": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'same' END AS decision, CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey % 10)::DOUBLE / 10 END AS confidence, CASE WHEN o_orderkey % 4 < 3 THEN 'r' END AS reasoning FROM orders",
    "resolve": f"""WITH {CANON}, o AS (SELECT group_id, string_agg(x.name, '|' ORDER BY x.ord) AS others FROM grouped x JOIN best USING (group_id) WHERE x.ord <> canonical_ord GROUP BY group_id)
      SELECT g.name AS original_name, canonical_name, 1.0::DOUBLE AS confidence_score, group_id, CASE WHEN g.ord = canonical_ord THEN coalesce(others, '') ELSE concat_ws('|', canonical_name, others) END AS alternatives, false AS llm_reviewed
      FROM grouped g JOIN best USING (group_id) LEFT JOIN o USING (group_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
