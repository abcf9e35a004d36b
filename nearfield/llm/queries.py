"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, exact_dedup, language, lexical, licenses, mixing, order_minhash, pii, quality, suffix_dedup, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.body = g.body
"""

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return decontaminate.hit_report(found)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP10_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM dwin JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""

def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n, round(pow(count(*), 0.5), 6) AS w FROM documents GROUP BY 1),
r AS (SELECT s, round(w * CAST((SELECT sum(n) FROM n) AS DOUBLE) / (SELECT sum(w) FROM n) / n, 9) AS rate FROM n),
q AS (SELECT s, rate, greatest(CAST(ceil(rate / 16.0) AS INT), 1) AS pieces FROM r),
c AS (SELECT s, 0 AS j, rate / pieces AS lam, exp(-rate / pieces) AS p, exp(-rate / pieces) AS c FROM q
      UNION ALL SELECT s, j + 1, lam, p * lam / (j + 1), c + p * lam / (j + 1) FROM c WHERE j < 80),
u AS (SELECT d.*, q.rate, i, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
      FROM (SELECT d.*, unnest(range(1, pieces + 1)) AS i FROM documents d JOIN q ON coalesce(d.source, '') = q.s) d
      JOIN q ON coalesce(d.source, '') = q.s),
k AS (SELECT u.doc_id, any_value(u.rate) AS rate, count(c.j) AS n_copies
      FROM u LEFT JOIN c ON coalesce(u.source, '') = c.s AND c.c <= u.u GROUP BY u.doc_id)
SELECT d.*, k.rate, k.n_copies, t.copy, md5('17:' || d.doc_id || ':' || t.copy) AS shuffle_key
FROM documents d JOIN k ON d.doc_id = k.doc_id, LATERAL (SELECT unnest(range(1, k.n_copies + 1)) AS copy) t
"""

def op6_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain_sql(x: str) -> str:
    names = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in warc.NAMED.items()) + "}"
    number = "CASE WHEN lower(r[2]) = 'x' THEN CAST('0x' || r[3:] AS BIGINT) ELSE CAST(r[2:] AS BIGINT) END"
    char = f"CASE WHEN r[1] = '#' THEN CASE WHEN {number} = 0 OR {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) ELSE chr(CAST({number} AS INTEGER)) END ELSE {names}[r] END"
    read = f"coalesce(list_transform([regexp_extract(p, {_q(warc.REFERENCE)}, 1)], lambda r: CASE WHEN r <> '' THEN ({char}) || p[len(r) + 2:] END)[1], '&' || p)"
    x = f"list_transform([string_split({x}, '&')], lambda parts: parts[1] || array_to_string(list_transform(parts[2:], lambda p: {read}), ''))[1]"
    return rf"trim(regexp_replace(regexp_replace({x}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _uuid_sql(x: str) -> str:
    return f"'urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


_N = "chr(13) || chr(10)"
OP4_SQL = f"""
WITH r AS (SELECT page_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date, coalesce(html, '') AS html,
  {_uuid_sql("'response|' || coalesce(CAST(page_id AS VARCHAR), 'null') || '|' || coalesce(url, 'null')")} AS refers_to,
  'HTTP/1.1 200 OK' || {_N} || 'Content-Type: text/html; charset=utf-8' || {_N} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) AS source_headers
  FROM pages),
b AS (SELECT *, 'sha256:' || sha256(html) AS source_digest,
  {_plain_sql(f"regexp_replace(regexp_replace(regexp_replace(html, {_q(warc.HIDDEN)}, '', 'g'), {_q(warc.BREAKS)}, chr(10), 'g'), {_q(warc.TAGS)}, '', 'g')")} AS text,
  trim(regexp_replace({_plain_sql(f"regexp_extract(html, {_q(warc.TITLE)}, 1)")}, '\\s+', ' ', 'g')) AS title,
  lower(regexp_extract(html, {_q(warc.LANGUAGE)}, 1)) AS lang,
  list_transform(regexp_extract_all(html, {_q(warc.LINKS)}, 1), lambda x: 'outlink: ' || regexp_replace(replace(trim(x, chr(34) || chr(39)), '&amp;', '&'), '\\s+', '%20', 'g') || ' L a/@href') AS links,
  {_uuid_sql("'conversion|' || refers_to")} AS conversion_id, {_uuid_sql("'metadata|' || refers_to")} AS metadata_id FROM r),
m AS (SELECT *, 'metadata' AS record_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
  array_to_string(list_concat(['source-status: HTTP/1.1 200 OK', 'source-header: Content-Type: text/html; charset=utf-8',
    'source-header: Content-Length: ' || octet_length(encode(html)), 'source-payload-digest: ' || source_digest,
    'conversion: <' || conversion_id || '>', 'title: ' || title, 'language: ' || lang], links), {_N}) || {_N} AS block FROM b
  UNION ALL SELECT *, 'conversion', conversion_id, 'text/plain', text FROM b),
d AS (SELECT page_id, record_type, record_id, refers_to, target_uri, date, source_headers, source_digest, content_type,
  CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM m)
SELECT *, array_to_string(['WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: <' || record_id || '>', 'WARC-Refers-To: <' || refers_to || '>',
  'WARC-Refers-To-Target-URI: ' || regexp_replace(target_uri, '[\r\n]+', ' ', 'g'), 'WARC-Refers-To-Date: ' || date,
  'WARC-Target-URI: ' || regexp_replace(target_uri, '[\r\n]+', ' ', 'g'), 'WARC-Date: ' || date, 'WARC-Block-Digest: ' || block_digest,
  'Content-Type: ' || content_type, 'Content-Length: ' || content_length], {_N}) || {_N} || {_N} || block AS record FROM d
"""

#: Vocabulary file; its path is a parameter of the operator.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op5_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def _op9_sql(rare: int = 8, least: float = 0.6) -> str:
    templates = ", ".join(
        f"({t}, '{label}', '{notice}', '{key}', {licenses._place(notice, key)})" for t, (label, notice, key) in enumerate(licenses.TEMPLATES)
    )
    stop = ", ".join(f"'{x}'" for x in sorted(licenses.STOP))
    base = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM pos WHERE "
        + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
        for phrase, label in licenses.BASE.items()
    )
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
base AS ({base}),
t AS (SELECT * FROM (VALUES {templates}) t(t, label, notice, key, place)),
posted AS (SELECT t, x, p FROM (SELECT t, unnest(string_split(notice, ' ')) AS x, unnest(range(len(string_split(notice, ' ')))) AS p FROM t) WHERE x NOT IN ({stop})),
spots AS (SELECT doc_id, i, w[i + 1] AS x FROM pos WHERE w[i + 1] IN (SELECT x FROM posted)),
idf AS (SELECT x, round(ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT doc_id) + 1)) + 1, 9) AS idf
        FROM (SELECT DISTINCT x FROM posted) LEFT JOIN spots USING (x) GROUP BY x),
own AS (SELECT t, x FROM (SELECT DISTINCT t, x FROM posted) JOIN idf USING (x) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, x) <= {rare}),
kept AS (SELECT t, x, p, idf FROM posted JOIN own USING (t, x) JOIN idf USING (x)),
whole AS (SELECT t, sum(idf) AS whole FROM kept GROUP BY t),
met AS (SELECT doc_id, t, i - p AS o, sum(idf) AS mass FROM spots JOIN kept USING (x) GROUP BY ALL),
hold AS (SELECT doc_id, t, o + place AS f, key, label, least(1.0, mass / whole) AS coverage FROM met JOIN whole USING (t) JOIN t USING (t)),
found AS (SELECT h.doc_id, h.label, round(coverage, 6) AS coverage FROM hold h JOIN d USING (doc_id)
          WHERE coverage >= {least} AND f >= 0 AND array_to_string(w[f + 1:f + len(string_split(key, ' '))], ' ') = key),
every AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS z FROM base GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
s AS (SELECT doc_id, max(coverage) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, b.f AS first_word, b.z AS last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), length=200).drop("spans")


OP12_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5_number(h[2 * i + 1:2 * i + 400]) AS m
      FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
hit AS (SELECT s.r, s.i FROM s JOIN (SELECT m FROM s GROUP BY m HAVING count(*) > 1) USING (m)),
new AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS first FROM hit),
run AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS k FROM new),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY r, k),
gone AS (SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 0) AS p FROM span),
kept AS (SELECT r, string_agg(h[2 * p + 1:2 * a], '' ORDER BY k) AS k, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans
         FROM gone JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, '') || h[2 * coalesce(z, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, row_number() OVER () AS i, list_distinct({_WORDS}) AS w FROM benchmark),
g AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM dw WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dw) GROUP BY r, t),
it AS (SELECT i, unnest(w) AS t FROM iw),
df AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t, big_n),
m AS (SELECT r, doc_id, 10 + CAST((90 * CAST(len(w) AS BIGINT) * big_n) // big_l AS BIGINT) AS m FROM dw, g WHERE len(w) > 0),
s AS (SELECT i, r, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
      FROM it JOIN tf USING (t) JOIN df USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, doc_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
      FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN iw USING (i) WHERE rank <= 10
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), threshold=100)


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM d),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, l.a AS l, r.a AS r, total.n,
        (1000 * CAST(cut.a AS HUGEINT) * CAST(total.n AS HUGEINT)) // (CAST(l.a AS HUGEINT) * CAST(r.a AS HUGEINT)) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.x JOIN f r ON r.lang = cut.lang AND r.phrase = cut.y JOIN total ON total.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (
    SELECT lang, k, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) o
  ON o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= 100 * c.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN held USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best WHERE rank <= 2000
"""


QUERIES = {
    "op11_dual_tree_search": op11_dual_tree_search,
    "op13_collocations": op13_collocations,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op9_license_index": op9_license_index,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_unigram_counts": op5_unigram_counts,
    "op6_pii_weak_supervision": op6_pii_weak_supervision,
    "op8_language_mixture": op8_language_mixture,
    "op1_quality_bayes": op1_quality_bayes,
    "op2_stream_exact_dedup": op2_stream_exact_dedup,
    "op3_poisson_mix": op3_poisson_mix,
    "op7_order_minhash": op7_order_minhash,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {"op11_dual_tree_search": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_collocations": OP13_SQL, "op9_license_index": _op9_sql(), "op4_warc_derivatives": OP4_SQL, "op2_stream_exact_dedup": OP2_SQL, "op3_poisson_mix": OP3_SQL, "op10_decontaminate": OP10_SQL}
