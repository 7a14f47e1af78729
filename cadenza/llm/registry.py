"""The queries of this package, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, divergence, fingerprints, licenses, minhash, mixing, prefix_trie, quality, secret_scan, suffixes, toxicity

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UNSPACED = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(_table(spark, sf_dir, "documents"))
    passages = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"])), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_repeated").cast("long").alias("n_repeated"), F.col("n_extra").cast("long").alias("n_extra"), passages.alias("passages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = secret_scan.joined(F.filter("secrets", lambda x: x["kind"] != "random"))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in secret_scan.KINDS), F.sha2(base, 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    seven = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.records_of(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(seven), mixed=True)).drop("n_unmapped")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_fingerprints, op3_decontamination, op4_secrets, op5_mixing, op6_chat_format, op7_minhash_dedup, op8_toxicity, op9_licenses, op10_quality, op11_prefix_trie, op12_divergence, op13_byte_bpe)}


_OP1 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, {_ABC}), '{_ALNUM}') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, len(ws) AS n_words, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, n_words, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM s),
r AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM h),
a AS (SELECT doc_id, n_words, i - 1 AS st, nth > 1 AS extra FROM r WHERE n > 1),
m AS (SELECT *, lag(st) OVER o AS before, max(st) FILTER (WHERE extra) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xbefore FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY st)),
g AS (SELECT *, least(50, coalesce(st - before, 50)) AS add, CASE WHEN extra THEN least(50, coalesce(st - xbefore, 50)) ELSE 0 END AS xadd,
  sum(CASE WHEN before IS NULL OR st - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY st) AS run FROM m),
p AS (SELECT doc_id, n_words, run, min(st) AS a, max(st) + 50 AS b, sum(add) AS n, sum(xadd) AS x FROM g GROUP BY doc_id, n_words, run)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(sum(n) AS BIGINT) AS n_repeated, CAST(sum(x) AS BIGINT) AS n_extra, string_agg(a || ':' || b, ',' ORDER BY a) AS passages FROM p GROUP BY doc_id, n_words
"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {_ABC}), '{_ALNUM}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bi AS (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT m FROM pat),
di AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m),
hit AS (SELECT doc_id, i, di.m, item FROM di JOIN pat ON pat.m = di.m AND pat.k = array_to_string(ws[i:i + di.m - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_UNSPACED}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s),
v AS (SELECT *, most / weight AS lim FROM w),
u AS (SELECT *, sum(most) OVER o - most AS below, sum(weight) OVER () - sum(weight) OVER o + weight AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM v WINDOW o AS (ORDER BY lim, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - below) / rest AS level FROM u),
f AS (SELECT level AS common FROM l WHERE level <= lim ORDER BY lim, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce(weight * (SELECT common FROM f), most)) AS target FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS step,
  CAST(('0x' || substr(md5('20/' || coalesce(d.source, '')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.place) AS r FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST((floor(start + step * r) - floor(start + step * (r - 1))) AS BIGINT) * size AS taken FROM k
"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS seven(conv_id, turn, role, text)),
control AS (SELECT unnest(['\', '<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) AS x),
e AS (SELECT conv_id, turn, role, text, CAST(to_json({'role': role, 'text': text}) AS VARCHAR) AS json, len('<|turn|><|says|><|end|>') + len(role) + len(text)
  + (SELECT sum((len(text) - len(replace(text, x, ''))) // len(x) + (len(role) - len(replace(role, x, ''))) // len(x)) FROM control) AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, json)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, json) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_UNSPACED}') AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS m FROM s),
x AS (SELECT doc_id, md5(unnest(sh)) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE 100 * n >= 80 * (cu.m + cv.m - n)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v)
SELECT c.doc_id, CAST(c.m AS BIGINT) AS n_shingles, min(root) AS component_id, c.doc_id = min(root) AS kept FROM c JOIN r ON r.node = c.doc_id GROUP BY c.doc_id, c.m
"""


_OP11 = rf"""
WITH RECURSIVE t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, sha256(len(role) || ':' || role || text) AS said, len(regexp_extract_all(text, '{_UNSPACED}')) AS words,
  row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) AS place FROM t),
crc(c, s, i, x) AS (SELECT DISTINCT c, CAST(c AS VARCHAR), 0, 4294967295::BIGINT FROM p UNION ALL
  SELECT c, s, i + 1, xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT) FROM (SELECT c, s, i, xor(x, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END::BIGINT) AS y FROM crc WHERE i < 8 * len(s))),
convs AS (SELECT crc.c, crc.c - crc.c % 20 AS head, xor(x, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = 8 * len(s)),
held AS (SELECT k.*, least(h, coalesce(b.n, 0)) AS lent FROM convs k LEFT JOIN (SELECT c, count(*) AS n FROM p GROUP BY c) b ON b.c = k.head),
r AS (SELECT k.c, p.place AS d, said, words FROM held k JOIN p ON p.c = k.head AND p.place <= k.lent
  UNION ALL SELECT k.c, p.place - k.h + k.lent, said, words FROM held k JOIN p ON p.c = k.c AND p.place > k.h),
pre AS (SELECT c, d, words, md5(string_agg(said, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM r UNION ALL SELECT c, 0, 0, 'root' FROM convs),
n AS (SELECT k, min(c) AS conv_id, min(d) AS depth, min(words) AS words, count(*) AS n_convs FROM pre GROUP BY k),
up AS (SELECT DISTINCT b.k, a.k AS pk FROM pre a JOIN pre b ON b.c = a.c AND b.d = a.d + 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
sub AS (SELECT a.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM n m JOIN pre a ON a.c = m.conv_id AND a.d <= m.depth LEFT JOIN kids ON kids.k = m.k GROUP BY a.k),
ends AS (SELECT k, string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) AS ids FROM pre JOIN (SELECT c, max(d) AS d FROM pre GROUP BY c) e ON e.c = pre.c AND e.d = pre.d GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sub ON sub.k = n.k LEFT JOIN up ON up.k = n.k LEFT JOIN n q ON q.k = up.pk LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_LETTERS}') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.total + v.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _OP1, "op3_decontamination": _OP3, "op5_mixing": _OP5, "op6_chat_format": _OP6, "op7_minhash_dedup": _OP7, "op11_prefix_trie": _OP11, "op12_divergence": _OP12}
