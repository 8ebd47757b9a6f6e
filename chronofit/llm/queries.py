"""One query for each operator of this package, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), over=85, under=100).withColumnRenamed("id", "doc_id")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    ranks, pattern = bpe.vocabulary(spark)
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: repeated passages of 50 words or more, paragraphs with a near copy anywhere, and those removed, as comma-joined numbers."""
    from .paragraphs import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_passages", "n_repeated", "n_removed", "n_paragraphs", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
l AS (SELECT doc_id, i, regexp_extract_all(translate(p[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t)),
x AS (SELECT doc_id, i, j, len(ws) AS m, ws[j] AS w, CASE WHEN j > 1 AND right(ws[j - 1], 1) IN ('.', '!', '?') THEN '0' ELSE '1' END || lpad((63 - least(63, octet_length(encode(ws[j]))))::VARCHAR, 2, '0') || rpad(substr(hex(encode(ws[j])), 1, 14), 14, '0') AS key
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM l)),
y AS (SELECT *, j > 9 AND m - j >= 9 AND key < min(key) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)
  AND key < min(key) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS border FROM x),
z AS (SELECT *, sum(CASE WHEN j = 1 OR border THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, j ROWS UNBOUNDED PRECEDING) - 1 AS no FROM y),
a AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS body FROM (SELECT doc_id, no, list(w ORDER BY i, j) AS w FROM z GROUP BY doc_id, no)),
b AS (SELECT row_number() OVER (ORDER BY body) AS k, body, any_value(w) AS w FROM a GROUP BY body),
g AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) < 5 THEN [body] ELSE list_transform(range(1, len(w) - 3), lambda q: array_to_string(w[q:q+4], ' ')) END) AS g FROM b),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
o AS (SELECT u.k AS a, v.k AS b, count(*) AS i FROM g u JOIN g v USING (g) WHERE u.k <> v.k GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n u ON u.k = a JOIN n v ON v.k = b WHERE 5 * i >= 4 * (u.n + v.n - i)),
r AS (SELECT k AS a, k AS b FROM b UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS k, min(b) AS comp FROM r GROUP BY 1),
m AS (SELECT doc_id, no, len(a.w) AS words, row_number() OVER (PARTITION BY comp ORDER BY doc_id, no) AS place, count(*) OVER (PARTITION BY comp) AS size FROM a JOIN b USING (body) JOIN c USING (k)),
s AS (SELECT doc_id, sum(words) AS words FROM (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM m WHERE size > 1) GROUP BY doc_id, run),
q AS (SELECT doc_id, count(*) AS n_passages FROM s WHERE words >= 50 GROUP BY 1),
d AS (SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (WHERE size > 1) AS n_repeated, count(*) FILTER (WHERE place > 1) AS n_removed, string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (WHERE place > 1) AS removed FROM m GROUP BY 1)
SELECT doc_id, coalesce(n_passages, 0) AS n_passages, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(removed, '') AS removed
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9).withColumnRenamed("id", "vec_id")


OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    pages = table(spark, sf_dir, "pages")
    found = html.extract(pages, html.fit(pages))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_turned")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON v.n = p.n AND v.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import restore, transform

    found = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe, secret_scan

    ranks, pattern = bpe.vocabulary(spark)
    found = secret_scan.find(table(spark, sf_dir, "documents"), ranks, pattern)
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; deviation is null where it doesn't fit a long, as it does up to some 10 million vectors."""
    from . import whitening

    vectors = table(spark, sf_dir, "embeddings")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = whitening.fit(vectors)
    if model is None:
        return spark.createDataFrame([], schema)
    share = F.array(*(F.lit(float(x)) for x in model.values / model.trace)) if len(model.values) else F.array().cast("array<double>")
    rows = whitening.transform(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(
        F.col("id").cast("long").alias("vec_id"), (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened", F.get(share, F.col("pos")).alias("explained"), F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
    )


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe, "op2_paragraphs": op2_paragraphs, "op5_suffix": op5_suffix, "op3_embeddings": op3_embeddings, "op4_minhash": op4_minhash, "op6_html": op6_html,
        "op7_language_id": op7_language_id, "op8_pii": op8_pii, "op9_warc": op9_warc, "op10_decontamination": op10_decontamination,
        "op11_infill": op11_infill, "op12_secrets": op12_secrets, "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_paragraphs": OP2_SQL, "op3_embeddings": OP3_SQL, "op4_minhash": OP4_SQL, "op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_infill": OP11_SQL}
