"""The queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscape.llm import ann, binary, decontaminate, filters, kneser, langid, licenses, packing, pii, repair, secrets, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(_table(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_blocks, op2_nearest_vectors, op3_url_filter, op4_best_fit_packing, op5_simhash, op6_decontamination, op7_perplexity_quality, op8_personal_data, op9_license_scan, op10_language_id, op11_secret_scan, op12_conversation_repair, op13_filter_audit)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di) JOIN bw USING (n, s)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Bit by bit, over ASCII."""
    byte = "list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


def _add(layer: str, cost: str, letter: str) -> str:
    """A layer's entry is its cost in nine digits and its audit, so that the least string is the least cost and then audit."""
    return f"(lpad(({layer}[1:9]::INT + {cost})::VARCHAR, 9, '0') || {layer}[10:] || '{letter}')"


def _layers() -> str:
    """Nothing yet, after system, user, assistant: rows first, then what may be inserted."""
    may, cost = "fault NOT IN ('blank', 'duplicate')", "5 * (fault = 'truncated')::INT"
    at = [_add(f"l.a{i}", "2", "D") for i in range(4)]
    put = lambda i, role: f"CASE WHEN {may} THEN CASE WHEN p = '{role}' THEN {_add(f'l.a{i}', cost, 'K')} ELSE {_add(f'l.a{i}', f'1 + {cost}', 'R')} END END"
    system = f"CASE WHEN {may} AND p = 's' THEN {_add('l.a0', cost, 'K')} END"
    rows = f"SELECT l.conv_id, l.i + 1 AS i, {at[0]} AS a0, least({at[1]}, {system}) AS a1, least({at[2]}, {put(0, 'u')}, {put(1, 'u')}, {put(3, 'u')}) AS a2, least({at[3]}, {put(2, 'a')}) AS a3 FROM l JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = l.i + 1"
    user = f"SELECT conv_id, i, a0, a1, least(a2, {_add('a0', '5', 'I')}, {_add('a1', '5', 'I')}, {_add('a3', '5', 'I')}) AS a2, a3 FROM ({rows})"
    return f"SELECT conv_id, i, a0, a1, least(a2, {_add('a3', '5', 'I')}) AS a2, a3 FROM (SELECT conv_id, i, a0, a1, a2, least(a3, {_add('a2', '5', 'I')}) AS a3 FROM ({user}))"


_REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
e AS (SELECT *, {_crc32('k')} % 20 AS d FROM c),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM e WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS body FROM g),
f AS (SELECT conv_id, turn, role, text, i, role[1] AS p, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
l AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS a0, NULL::VARCHAR AS a1, '000000005I' AS a2, '000000010II' AS a3 FROM conversations UNION ALL {_layers()}),
b AS (SELECT conv_id, least(a0, a3) AS a FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
x AS (SELECT conv_id, a[10:] AS audit, unnest(range(1, length(a) - 8)) AS j FROM b),
y AS (SELECT *, audit[j] AS e, j - length(replace(audit[1:j], 'I', '')) AS skipped, length(replace(audit[1:j], 'D', '')) AS place FROM x),
z AS (SELECT y.*, f.role, f.text, f.p, max((e = 'K' AND place = 1 AND p = 's')::INT) OVER (PARTITION BY y.conv_id) AS first FROM y LEFT JOIN f ON y.conv_id IS NOT DISTINCT FROM f.conv_id AND e <> 'I' AND f.i = j - skipped),
w AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN (place - first) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM z WHERE e <> 'D' GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY i) || p AS pair FROM f) GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, a[1:9]::BIGINT AS cost, a[10:] AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM b LEFT JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN w ON b.conv_id IS NOT DISTINCT FROM w.conv_id
"""

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN g USING (doc_id)),
h AS (SELECT part, f, good, toxic, count(*) AS n, len(list_filter(f, lambda b: b)) AS k FROM m GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS x),
p AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, list_aggregate(list_transform(o, lambda v: chr(64 + v::INT)), 'string_agg', '') AS filter_order, x AS step, o[x] AS own FROM p, i),
r AS (SELECT *, list_bool_or(list_transform(list_append(o[1:step - 1], NULL), lambda v: f[v])) AS earlier FROM h, s)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (NOT f[own] AND NOT coalesce(earlier, false)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (f[own] AND NOT coalesce(earlier, false)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (f[own] AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (f[own] AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (f[own] AND NOT coalesce(earlier, false) AND good = 1), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (f[own] AND NOT coalesce(earlier, false) AND toxic = 1), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (f[own]), 0)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, fingerprints, trees, automata, compressors and language models are no SQL; tests hold those queries against brute force."""
    return {"op6_decontamination": _CONTAMINATION, "op12_conversation_repair": _REPAIR, "op13_filter_audit": _AUDIT}
