"""The queries of this subpackage: (spark, folder of tables) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import audit, chat, mixing, neargraph, packing, phrases, quality, shards, simhash, substring, tokenfile, topk, urlfilter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_topk_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, same_id=True)


def op5_addressable_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = tokenfile.dataset_folder(spark, "tokens")
    tokenfile.write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_documents(spark.read.parquet(files))


URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.filter_urls(_table(spark, folder, "pages"), rules)


def op7_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(_table(spark, folder, "conversations"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op9_tiered_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arrive in eight batches, are appended, compacted after each and read back from the last version."""
    docs = _table(spark, folder, "documents")
    store = shards.Shards(spark, tokenfile.dataset_folder(spark, "shards"))
    for batch in shards.arrivals(docs, "doc_id", 8):
        store.append(batch)
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit.divergence(_table(spark, folder, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neargraph.near_vectors(_table(spark, folder, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_topk_uniform_threshold": op4_topk_uniform_threshold,
    "op5_addressable_tokens": op5_addressable_tokens,
    "op6_url_rules": op6_url_rules,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_tiered_shards": op9_tiered_shards,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), found AS (
            SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS (
            SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 30
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
        ), v AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), groups AS (
            SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(w, 0) AS w
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN v USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS w FROM counts GROUP BY ALL) USING (lang, source)
        ), shares AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                   1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (w + 5 * v) AS p
            FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ), wholes AS (
            SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
            FROM counts JOIN v USING (lang) GROUP BY lang, term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), placed AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM placed QUALIFY part = 'pair' OR rank <= 50""",
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                   embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
            FROM embeddings
        ), links AS (
            SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.label = b.label AND a.i <> b.i AND a.usable AND b.usable
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reached(a, b) AS (
            SELECT i, i FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
        ), component AS (
            SELECT a AS i, min(vec_id) AS component_id FROM reached JOIN v ON v.i = reached.b GROUP BY a
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.i) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN component USING (i)""",
    "op13_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
        ), totals AS (
            SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang
        ), begun AS (
            SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
        ), spans AS (
            SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM begun
        ), f AS (
            SELECT lang, list_slice(ws, i, i + m - 1) AS w, count(*) AS a FROM spans GROUP BY ALL HAVING count(*) >= 100
        ), longer AS (
            SELECT lang, w, max(a) AS of FROM (
                SELECT lang, list_slice(w, 1, len(w) - 1) AS w, a FROM f UNION ALL SELECT lang, list_slice(w, 2, len(w)), a FROM f
            ) GROUP BY ALL
        ), whole AS (
            SELECT f.* FROM f LEFT JOIN longer USING (lang, w) WHERE len(f.w) > 1 AND (of IS NULL OR of < f.a)
        ), cuts AS (
            SELECT c.lang, c.w, c.a, k, x.a AS l, y.a AS r, CAST(n AS BIGINT) AS n,
                   CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS score
            FROM (SELECT *, unnest(range(1, len(w))) AS k FROM whole) c
            JOIN f x ON x.lang = c.lang AND x.w = list_slice(c.w, 1, k)
            JOIN f y ON y.lang = c.lang AND y.w = list_slice(c.w, k + 1, len(c.w))
            JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT *, array_to_string(w, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM lowest QUALIFY rank <= 2000""",
    "op7_perspective_rotation": """
        WITH rows AS (
            SELECT conv_id, turn, CASE WHEN trim(role) = '' OR role IS NULL THEN 'unknown' ELSE role END AS s, coalesce(text, '') AS x
            FROM conversations
        ), people AS (
            SELECT DISTINCT conv_id, s AS perspective FROM rows WHERE s <> 'system'
        ), seen AS (
            SELECT r.conv_id, perspective, turn, s, x,
                   CASE WHEN s = 'system' THEN 'system' WHEN s = perspective THEN 'assistant' ELSE 'user' END AS role
            FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
        ), told AS (
            SELECT *, CASE WHEN role = 'user' THEN s END AS name,
                   '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || s ELSE '' END || chr(10) AS head
            FROM seen
        ), placed AS (
            SELECT *, head || x || '<|im_end|>' || chr(10) AS segment,
                   sum(length(head || x || '<|im_end|>' || chr(10)))
                       OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, s, x ROWS UNBOUNDED PRECEDING) AS e
            FROM told
        )
        SELECT conv_id, perspective, turn, role, name, segment,
               CAST(e - length(segment) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end,
               CASE WHEN role = 'assistant' THEN CAST(e - length(segment) + length(head) AS BIGINT) END AS loss_start,
               CASE WHEN role = 'assistant' THEN CAST(e - 1 AS BIGINT) END AS loss_end
        FROM placed""",
    "op9_tiered_shards": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op4_topk_uniform_threshold": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op6_url_rules": """
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), fits AS (
            SELECT p.*, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
            FROM parts p LEFT JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
}
