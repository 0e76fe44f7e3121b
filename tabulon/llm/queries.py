"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from .common import held_out
from .embeddings import near_vectors
from .exact_dedup import exact_dedup
from .lm import score_documents
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack
from .phrases import collocations
from .pii import digest, personal_data
from .substring import substring_dedup
from .token_files import token_file_round_trip
from .toxicity import toxicity
from .warc import warc_round_trip
from .whitening import whiten

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    return token_file_round_trip(table(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("row")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    test = held_out(F.col("doc_id"), 0)
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~test)
    return found.select("doc_id", test.alias("held_out"), "score", "predicted")


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hex FROM p),
bits AS (SELECT page_id, strlen(html) AS payload_bytes, first_id, hex FROM q),
digits AS (SELECT page_id, payload_bytes, first_id,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + CAST(i // 8 * 10 AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest
    FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digits
""")
def op9_warc(spark, sf_dir):
    found = warc_round_trip(table(spark, sf_dir, "pages")).filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_near_vectors", """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
""")
def op7_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_near_dup", """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)
""")
def op10_near_dup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM
         (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


@query("op13_pii")
def op13_pii(spark, sf_dir):
    return digest(personal_data(table(spark, sf_dir, "documents")))


@query("op12_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws[i:i + k - 1] AS gram FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) t(k))),
f AS (SELECT lang, gram, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, gram, f AS a, unnest(range(1, len(gram))) AS k FROM f WHERE len(gram) > 1),
scored AS (SELECT c.lang, c.gram, a, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score,
           row_number() OVER (PARTITION BY c.lang, c.gram ORDER BY 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f), k) AS place
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1:k] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1:] JOIN n ON n.lang = c.lang),
parts AS (SELECT DISTINCT lang, f, gram[i:j] AS gram FROM (SELECT lang, gram, f, i, unnest(range(i + 1, len(gram) + 1)) AS j
          FROM (SELECT lang, gram, f, unnest(range(1, len(gram))) AS i FROM f WHERE len(gram) > 2)) WHERE j - i + 1 < len(gram)),
longer AS (SELECT lang, gram, max(f) AS f FROM parts GROUP BY ALL),
kept AS (SELECT s.lang, array_to_string(s.gram, ' ') AS phrase, a, l, r, n, score FROM scored s LEFT JOIN longer USING (lang, gram)
         WHERE place = 1 AND NOT coalesce(100 * longer.f >= 100 * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
""")
def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
