"""Named queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm import attribution, hmm, neardup, negatives, packing, quality, records, resharding, secrets, substrings, tiling, warc, whitening
from termscan.llm.storage import numbered, ship_package
from termscan.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document also holds, removed."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("id", "keeper_id")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as framed records in doc_id order and read back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = records.with_start(records.write_records(documents, tokenizer_path(WORD_TOKENIZER), end_id=2))
    place = index.select(F.col("file").alias("_file"), F.col("row").alias("_row"), "start")
    read = records.read_records(index).select(
        "file", "row", "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
    joined = read.join(place, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")))
    return joined.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of boosted trees for every document."""
    documents = table(spark, sf_dir, "documents")
    forest = quality.train_quality(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, forest)


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    documents = table(spark, sf_dir, "documents")
    cut = packing.pieces(documents, tokenizer_path(BYTE_TOKENIZER), end_id=0)
    return packing.with_places(packing.digests(cut), packing.places(cut)).drop("row")


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents moved from five shards to eight of equal bytes, as read from the new layout."""
    layout, sizes = resharding.write_layout(table(spark, sf_dir, "documents"), 5)
    rows = resharding.reshard(spark, layout, sizes, 8).read(spark).select(
        "doc_id", resharding.row_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard",
    )
    ranked = numbered(rows, ["shard"], ["doc_id", "text_crc32"], name="slots")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, whole or reordered."""
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole."""
    return attribution.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    read = warc.read_archives(warc.write_archives(pages))
    return read.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the base patterns and of values that are costly to guess, for every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 largest principal components, scaled to unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; some labels are shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_records": op3_token_records,
    "op4_hidden_markov": op4_hidden_markov,
    "op5_quality_rules": op5_quality_rules,
    "op6_sequence_packing": op6_sequence_packing,
    "op7_flow_resharding": op7_flow_resharding,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_section_tokens": op9_section_tokens,
    "op10_warc_archives": op10_warc_archives,
    "op11_secret_scan": op11_secret_scan,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
                   FROM documents),
        s AS (SELECT doc_id, words, len(words) AS n FROM d),
        w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
              FROM (SELECT doc_id, words, unnest(range(1, n - 48)) AS i FROM s WHERE n >= 50)),
        g AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM w JOIN g USING (win) WHERE doc_id > least),
        k AS (SELECT s.doc_id, p.i, s.words[p.i] AS word FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS i) p),
        l AS (SELECT k.doc_id, count(*) FILTER (c.i IS NOT NULL) AS n_removed,
                     string_agg(k.word, ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept
              FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY k.doc_id)
        SELECT s.doc_id, s.n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM s LEFT JOIN l ON s.doc_id = l.doc_id""",
    "op2_jaccard_join": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                     ELSE array_to_string(words[i:i + 4], ' ') END AS sh
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 5 * c >= 4 * (na.n + nb.n - c)),
        r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
        sets AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS k FROM s GROUP BY doc_id),
        t AS (SELECT a, count(DISTINCT k) AS texts FROM l JOIN sets ON sets.doc_id = b WHERE NOT same GROUP BY a)
        SELECT d.doc_id, c.class_id, coalesce(x.n_links, 0) AS n_links, coalesce(t.texts, 0) AS n_text_links,
               coalesce(n.n, 0) AS n_shingles
        FROM d JOIN (SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id) c USING (doc_id)
        LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) x ON x.a = d.doc_id
        LEFT JOIN t ON t.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
                          strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT digest, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN g.response IS NULL OR g.response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN g.response <> page_id THEN g.response END AS refers_to
        FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000""",
    "op13_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                     list_dot_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                     row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
        n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND place <= 5
                   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 10""",
}
