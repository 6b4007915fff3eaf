"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.llm import jaccard_join, language_id, line_dedup, merkle, mixing, near_vectors, packing, personal_data, sharding, substring_dedup, token_files, top_k, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARD_BYTES = 8 << 20


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    WHERE rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(rows, F.col("vec_id") % 50 == 0, lambda x: F.floor(x * 256).cast("long"))


@query(
    "op2_extendible_hash_shards",
    f"""
    WITH RECURSIVE rows AS (
        SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS row_bytes,
            lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT), 48, '0') AS bits
        FROM documents),
    buckets(prefix, depth, bytes, n) AS (
        SELECT '', 0, sum(row_bytes)::BIGINT, count(*) FROM rows HAVING count(*) > 0
        UNION ALL
        SELECT r.prefix, r.depth, r.bytes, r.n FROM (
            SELECT substr(bits, 1, b.depth + 1) AS prefix, b.depth + 1 AS depth, sum(row_bytes)::BIGINT AS bytes, count(*) AS n
            FROM buckets b JOIN rows ON substr(bits, 1, b.depth) = b.prefix
            WHERE b.bytes > {SHARD_BYTES} AND b.depth < 48 GROUP BY ALL) r)
    SELECT r.doc_id, b.prefix AS shard, b.depth AS shard_depth, r.row_bytes, b.bytes AS shard_bytes, b.n AS shard_rows,
        b.bytes > {SHARD_BYTES} AS oversized
    FROM rows r JOIN buckets b ON substr(r.bits, 1, b.depth) = b.prefix
    WHERE b.bytes <= {SHARD_BYTES} OR b.depth = 48
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return rows.select("doc_id", "shard", "shard_depth", "row_bytes", "shard_bytes", "shard_rows", "oversized")


@query("op3_multiprobe_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_vectors.nearest(rows, F.col("vec_id") % 50 == 0)


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op5_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, i, list[i] AS line,
            translate(trim(list[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS list FROM documents), unnest(range(1, len(list) + 1)) AS u(i)),
    firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key)
    SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(l.doc_id > first, false)) AS n_dropped,
        sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT coalesce(l.doc_id > first, false)), '')) AS kept_sha256
    FROM lines l LEFT JOIN firsts USING (key) GROUP BY l.doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_huffman_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), folder)
    return token_files.read_tokens(spark, folder, with_ids=False)


@query("op7_best_two_fit")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer(), keep_ids=False))


@query("op8_weak_supervised_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.summary(docs, personal_data.find(docs))


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_language_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op11_feast_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows))


@query(
    "op12_merkle_manifest",
    """
    WITH RECURSIVE rows AS (
        SELECT row_number() OVER () AS k, doc_id, lang,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) % 3 = 0 AS touched
        FROM documents),
    framed AS (
        SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low
        FROM rows),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS m FROM framed),
    trees(lang, level, idx, digest, m) AS (
        SELECT lang, 0, rank, leaf, m FROM leaves
        UNION ALL
        SELECT t.lang, t.level, t.idx, t.digest, t.m FROM (
            SELECT lang, level + 1 AS level, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (any_value(m) + 7) // 8 AS m
            FROM trees WHERE m > 1 GROUP BY lang, level, idx // 8) t),
    subroots AS (
        SELECT lang, digest, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS m FROM trees WHERE m = 1),
    tops(level, idx, digest, m) AS (
        SELECT 0, rank, digest, m FROM subroots
        UNION ALL
        SELECT t.level, t.idx, t.digest, t.m FROM (
            SELECT level + 1 AS level, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (any_value(m) + 7) // 8 AS m
            FROM tops WHERE m > 1 GROUP BY level, idx // 8) t),
    places AS (
        SELECT l.k, n.level AS step, string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < l.rank // (8 ** n.level)::BIGINT) AS before,
            string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > l.rank // (8 ** n.level)::BIGINT) AS after
        FROM leaves l JOIN trees n ON n.lang IS NOT DISTINCT FROM l.lang AND n.idx // 8 = l.rank // (8 ** (n.level + 1))::BIGINT AND n.m > 1
        GROUP BY ALL
        UNION ALL
        SELECT l.k, s.depth + n.level, string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < s.rank // (8 ** n.level)::BIGINT),
            string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > s.rank // (8 ** n.level)::BIGINT)
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
        JOIN tops n ON n.idx // 8 = s.rank // (8 ** (n.level + 1))::BIGINT AND n.m > 1
        GROUP BY ALL),
    folds(k, step, digest) AS (
        SELECT k, 0, CASE WHEN touched THEN low ELSE leaf END FROM leaves
        UNION ALL
        SELECT f.k, f.step + 1, sha256(coalesce(p.before, '') || f.digest || coalesce(p.after, '')) FROM folds f JOIN places p ON p.k = f.k AND p.step = f.step),
    proofs AS (SELECT k, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step) AS siblings FROM places GROUP BY k),
    ends AS (SELECT k, arg_max(digest, step) AS folded_root FROM folds GROUP BY k)
    SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
        e.folded_root, e.folded_root = r.digest AS verified
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT digest FROM tops WHERE m = 1) r ON true
    JOIN ends e ON e.k = l.k LEFT JOIN proofs p ON p.k = l.k
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


@query(
    "op13_substring_dedup",
    r"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    windows AS (
        SELECT k, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
        FROM docs, unnest(range(1, len(words) - 48)) AS u(i)),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    late AS (SELECT k, i FROM windows JOIN firsts USING (h) WHERE doc_id > first),
    places AS (SELECT k, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM docs),
    marked AS (
        SELECT p.k, p.i, p.word, coalesce(max(l.i) OVER (PARTITION BY p.k ORDER BY p.i) > p.i - 50, false) AS gone
        FROM places p LEFT JOIN late l ON l.k = p.k AND l.i = p.i),
    kept AS (
        SELECT k, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text
        FROM marked GROUP BY k)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (k)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
