"""The queries of this package and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomolake.llm import audit, crosspolytope, fim, hnsw, langid, lm, mixing, packing, pieces, pii, shards, simhash, toxicity
from tomolake.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(table(spark, sf_dir, "documents"), model, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}


_TAKEN = """floor(quota / n)::BIGINT * {x}
        + 16 * (floor((({x} // 16) + phase) * (quota % n) / n)::BIGINT - floor(phase * (quota % n) / n)::BIGINT)
        + ({x} - ({x} // 16) * 16) * (floor((({x} // 16) + 1 + phase) * (quota % n) / n)::BIGINT
                                    - floor((({x} // 16) + phase) * (quota % n) / n)::BIGINT)"""

OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', chr(1), 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS want
  FROM sources),
levels AS (
  SELECT *, (want - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         least(most, coalesce((max(CASE WHEN own * weight <= most THEN own END) OVER ()) * weight, most)) AS target
  FROM levels),
seats AS (SELECT sum(target) AS t, round(sum(target) / 16)::BIGINT AS seats FROM goals),
ranked AS (
  SELECT source, row_number() OVER (ORDER BY q DESC, source ASC NULLS LAST, k) AS r
  FROM (SELECT source, k, target / (2 * k - 1) AS q FROM goals, seats,
        LATERAL (SELECT unnest(range(1, (target * seats / nullif(t, 0) + 2 + 3 * (SELECT count(*) FROM goals))::BIGINT)) AS k))),
quotas AS (
  SELECT g.source, any_value(source_size) AS source_size, any_value(target) AS target,
         count(r.r) FILTER (r.r <= (SELECT seats FROM seats)) AS source_quota,
         greatest(1, ceil(any_value(source_size) / 1000000))::BIGINT AS parts
  FROM goals g LEFT JOIN ranked r ON g.source IS NOT DISTINCT FROM r.source GROUP BY g.source),
placed AS (
  SELECT s.doc_id, s.size, s.source, q.source_size, q.target, q.source_quota,
         md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')) AS h,
         ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % q.parts AS shard
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
lined AS (
  SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM placed),
cells AS (SELECT source, shard, sum(size)::BIGINT AS length, any_value(source_quota) AS source_quota FROM placed GROUP BY ALL),
cell_ranked AS (
  SELECT source, shard, source_quota,
         row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS r
  FROM (SELECT source, shard, source_quota, k, length / (2 * k - 1) AS q FROM cells, LATERAL (
        SELECT unnest(range(1, (length / 4 + 10)::BIGINT)) AS k) WHERE length > 0)),
cell_quotas AS (
  SELECT c.source, c.shard, ceil(any_value(length) / 16)::BIGINT AS n,
         least(count(r.r) FILTER (r.r <= r.source_quota), 2 * ceil(any_value(length) / 16)::BIGINT) AS quota
  FROM cells c LEFT JOIN cell_ranked r ON c.source IS NOT DISTINCT FROM r.source AND c.shard = r.shard
  GROUP BY c.source, c.shard),
phased AS (
  SELECT *, CASE WHEN n > 0 THEN ('0x' || substr(md5('mix-1#' || shard::VARCHAR), 1, 8))::BIGINT % n ELSE 0 END AS phase
  FROM cell_quotas)
SELECT l.doc_id, l.size, l.source_size, l.target,
       CASE WHEN n > 0 THEN (({_TAKEN.format(x="l.stop")}) - ({_TAKEN.format(x="(l.stop - l.size)")}))::BIGINT ELSE 0 END AS taken
FROM lined l JOIN phased p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard
"""

OP12_SQL = """
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
worded AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT coalesce(w.lang, '') AS part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (len(words) < 100)::INT AS a,
         (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
         (100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 10 * length(w.text))::INT AS c,
         regexp_matches(w.text, '[#$%&*|]')::INT AS d,
         coalesce(w.doc_id > f.first_id, false)::INT AS e
  FROM worded w JOIN firsts f ON w.text = f.text LEFT JOIN marked m ON w.doc_id = m.doc_id),
patterns AS (
  SELECT part, [a, b, c, d, e] AS bits, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [v.k, w.k, x.k, y.k, z.k] AS places
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
steps AS (
  SELECT array_to_string(list_transform(places, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, places, step, places[step] AS own
  FROM orders, LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (
  SELECT part, filter_order, step, own, docs, good, toxic, bits[own] AS fails,
         list_sum(list_transform(places[1:step - 1], lambda k: bits[k])) > 0 AS gone, list_sum(bits) AS n
  FROM steps, patterns),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(docs) FILTER (NOT coalesce(gone, false) AND fails = 0), 0)::BIGINT AS kept,
         coalesce(sum(docs) FILTER (NOT coalesce(gone, false) AND fails = 1), 0)::BIGINT AS removed,
         coalesce(sum(docs) FILTER (coalesce(gone, false) AND fails = 1), 0)::BIGINT AS redundant,
         coalesce(sum(docs) FILTER (fails = 1 AND n = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND fails = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND fails = 1), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

OP13_SQL = """
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM lined),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS last FROM hashed),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                 WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:first], '') AS prefix, array_to_string(units[first + 1:last], '') AS middle,
         array_to_string(units[last + 1:], '') AS suffix
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""
