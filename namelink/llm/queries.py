"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, licenses, mixing, packing, quality, simhash, substrings, toxicity, urls
from .common import table


def default_vocabulary() -> str:
    """The public byte-level vocabulary of the contract; any other path can be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = mixing.by_length(mixing.sized(table(spark, sf_dir, "documents")))
    return mixing.copies(slim, mixing.plan(slim)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejects(quality.BASE).alias("base_failed"), (~quality.rejects(quality.POLICIES[quality.CURRENT])).alias("kept"), "failed",
    )


def op6_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.render(turns, chat.maximal(turns))


URL_RULES = (
    urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"), urls.Rule("block", "example.net/de/8"),
    urls.Rule("block", "org/es/"),
)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows the document whose number its path names; it is bad if that document's quality label is 0."""
    number = F.regexp_extract(urls.split_url(F.col("url"))[1], "/([0-9]{1,18})", 1).try_cast("long")
    bad = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    shown = pages.select("page_id", number.alias("_doc")).where("_doc is not null")
    return shown.join(bad, "_doc").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_fingerprints": op2_fingerprints,
        "op3_simhash": op3_simhash,
        "op4_licenses": op4_licenses,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_substrings": op7_substrings,
        "op8_chat": op8_chat,
        "op9_urls": op9_urls,
        "op10_toxicity": op10_toxicity,
    }


# Scale, whole copies, Pareto rank and cut as in the operator; the scale from the number of length classes at the cap.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(n % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size,
         round(least(cap, coalesce((SELECT arg_min(level, (cap / weight, n)) FROM l WHERE level * weight <= cap) * weight, cap)), 6) AS target
  FROM l
), q AS (
  SELECT *, CASE WHEN size >= 500 THEN 3 WHEN size >= 50 THEN 2 ELSE 1 END AS preference FROM d
), k AS (
  SELECT source, preference, sum(size)::BIGINT AS words FROM q GROUP BY ALL
), j AS (
  SELECT source, preference, coalesce(sum(words) OVER w - words, 0)::DOUBLE AS capped, nullif(sum(words * preference) OVER v, 0)::DOUBLE AS open FROM k
  WINDOW w AS (PARTITION BY source ORDER BY preference DESC), v AS (PARTITION BY source ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), g AS (
  SELECT j.source, arg_max((target - 3 * capped) / open, preference) AS scale FROM j JOIN t ON j.source IS NOT DISTINCT FROM t.source
  WHERE (target - 3 * capped) / open * preference < 3 GROUP BY j.source
), r AS (
  SELECT t.*, least(coalesce(target / nullif(source_size, 0), 0), 3.0)::DOUBLE AS rate, coalesce(scale, CASE WHEN source_size = 0 THEN 0.0 ELSE 3.0 END)::DOUBLE AS scale
  FROM t LEFT JOIN g ON t.source IS NOT DISTINCT FROM g.source
), o0 AS (
  SELECT q.doc_id, q.size, r.source, r.source_size, r.target, least(scale * preference, 3.0::DOUBLE) AS expected, floor(rate) AS rate_whole, rate,
         (('0x' || md5('mix:' || coalesce(q.doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS v
  FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source
), o1 AS (
  SELECT *, floor(expected)::BIGINT AS whole, greatest(least(expected - floor(expected), 1 - 1e-9::DOUBLE), 1e-9::DOUBLE) AS p,
         greatest(least(rate - rate_whole, 1 - 1e-9::DOUBLE), 1e-9::DOUBLE) AS pr FROM o0
), o2 AS (
  SELECT *, v / (1 - v) / (p / (1 - p)) * (pr / (1 - pr)) AS scaled FROM o1
), o AS (
  SELECT doc_id, size, source, source_size, target, whole, CASE WHEN whole >= 3 THEN 2.0::DOUBLE ELSE scaled / (1 + scaled) END AS u,
         target - sum(whole * size) OVER (PARTITION BY source) AS need FROM o2
), c AS (
  SELECT *, sum(CASE WHEN whole < 3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u, doc_id) AS upto FROM o
), x AS (
  SELECT source, min(upto) AS upto FROM c WHERE upto >= need AND need > 0 AND whole < 3 GROUP BY source
), e AS (
  SELECT c.source, c.upto, max(c.upto) - sum(c.size) AS before FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source AND c.upto = x.upto AND c.whole < 3 GROUP BY ALL
)
SELECT c.doc_id, c.size, c.source_size, c.target, copies * c.size AS taken, copies
FROM (
  SELECT c.*, c.whole + CASE WHEN whole >= 3 OR need <= 0 THEN 0 WHEN e.upto IS NULL OR c.upto < e.upto THEN 1
                             WHEN c.upto = e.upto AND e.upto - need < need - e.before THEN 1 ELSE 0 END AS copies
  FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source
) c
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM g WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * word_chars < 5 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (100 * n_repeat_words > 30 * n_words)::INT + 128 * (n_words = 0)::INT)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed FROM f
"""


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS k,
         string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''), '') OVER w AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), m AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_equal FROM t WHERE k = n GROUP BY prefix
), x AS (
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k < t.n AND t.prefix = m.prefix)
)
SELECT x.conv_id, n_turns, n_equal,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM x JOIN t ON x.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
"""


def _op9_sql() -> str:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.verdict}'" for r in ordered)
    level = """, v{k} AS (
  SELECT {parents}, count(*) >= 20 AND count(*) * 5 > sum(n) AS wild FROM (SELECT {parents}, s{k}, sum(n) AS n FROM h{j} WHERE s{k} <> '' GROUP BY ALL) GROUP BY {parents}
), h{k} AS (SELECT h{j}.*, CASE WHEN wild AND s{k} <> '' THEN '/*' ELSE s{k} END AS t{k} FROM h{j} LEFT JOIN v{k} USING ({parents}))"""
    levels = "".join(level.format(k=k, j=k - 1, parents=", ".join(["host", *(f"t{i}" for i in range(1, k))])) for k in (1, 2, 3))
    # The tables' paths have at most three segments, so three levels, deepest first, are the whole tree.
    merge = """, g{k} AS (
  SELECT *, sum(bad) OVER (PARTITION BY {parents}, t{k} || m{j}) AS b{k}, sum(labelled) OVER (PARTITION BY {parents}, t{k} || m{j}) AS l{k},
         sum(bad) OVER (PARTITION BY {parents}) / greatest(sum(labelled) OVER (PARTITION BY {parents}), 1) AS p{k} FROM {source}
), n{k} AS (SELECT *, CASE WHEN {above} THEN '' WHEN max(t{k} || m{j}) OVER (PARTITION BY {parents}) <> '' AND power(b{k} - l{k} * p{k}, 2) <= 4 * l{k} * p{k} * (1 - p{k}) THEN '~' ELSE t{k} || m{j} END AS m{k} FROM g{k})"""
    merges = "".join(
        merge.format(k=k, j=k + 1, parents=", ".join(["host", *(f"t{i}" for i in range(1, k))]), source="e0" if k == 3 else f"n{k + 1}", above=f"t{k - 1} = ''" if k > 1 else "false")
        for k in (3, 2, 1)
    )
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), p AS (
  SELECT page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host, path, string_split(path, '/') AS f,
         TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT) AS doc FROM u
), q AS (
  SELECT page_id, host, path, doc,
    [coalesce('/' || regexp_replace(regexp_replace(s, '\b[0-9a-f]{{12,}}\b', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '')
     FOR s IN [f[2], f[3], CASE WHEN len(f) > 3 THEN array_to_string(f[4:], '/') END]] AS s FROM p
), g AS (
  SELECT page_id, max(bad) AS bad FROM q JOIN (SELECT doc_id AS doc, max((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY ALL) USING (doc) GROUP BY page_id
), h0 AS (
  SELECT host, s[1] AS s1, s[2] AS s2, s[3] AS s3, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM q LEFT JOIN g USING (page_id) GROUP BY ALL
){levels}, e0 AS (SELECT *, '' AS m4 FROM h3){merges}, m0 AS (
  SELECT *, (sum(bad) OVER (PARTITION BY host) + 10 * ((sum(bad) OVER () + 1) / (sum(labelled) OVER () + 2))) / (sum(labelled) OVER (PARTITION BY host) + 10) AS hp FROM n1
), z AS (
  SELECT host, s1, s2, s3, host || m1 AS template, round((sum(bad) OVER (PARTITION BY host, m1) + 10 * hp) / (sum(labelled) OVER (PARTITION BY host, m1) + 10), 6) AS purity FROM m0
)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM q JOIN z USING (host) WHERE z.s1 = s[1] AND z.s2 = s[2] AND z.s3 = s[3]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op5_quality": OP5_SQL, "op8_chat": OP8_SQL, "op9_urls": _op9_sql()}
