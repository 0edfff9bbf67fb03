"""Registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relearn.llm import (
    bit_clusters, conversations, decontaminate, language, ngram_join, quality, secrets, sentence_pieces, token_counts,
    toxicity, url_filter, vector_search, warc,
)
from relearn.llm.common import crc_mod

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), crc_mod(F.col("doc_id"), 4) == 2
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(docs, table(spark, folder, "labels"), ~held))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    found = language.identify_language(docs, language.learn_prototypes(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def derived_edits() -> Column:
    """Three edits of a text, from the text: a repeated beginning, a cut, and a word in capitals."""
    n = F.length(F.coalesce("text", F.lit("")))
    place = lambda share: F.floor(n * share).cast("long")
    edit = lambda at, gone, put: F.struct(at.alias("at"), gone.cast("long").alias("gone"), put.alias("put"))
    word = F.substr("text", (place(0.75) + 1).cast("int"), F.lit(9))
    return F.array(
        edit(place(0.25), F.lit(0), F.substr("text", F.lit(1), F.lit(24))),
        edit(place(0.5), F.least(F.lit(15), n - place(0.5)), F.lit("")),
        edit(place(0.75), F.length(F.coalesce(word, F.lit(""))), F.upper(word)),
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trees = token_counts.token_trees(docs, BYTE_RANKS).withColumn("edits", derived_edits())
    counted = token_counts.apply_edits(trees, BYTE_RANKS)
    return counted.select(
        "doc_id", "n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", "n_applied", "n_skipped", F.size("leaves").alias("n_leaves")
    )


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES, rounds=None)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_archives(table(spark, folder, "pages"))[0]


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    samples = sentence_pieces.encode_samples(table(spark, folder, "documents"), PIECE_MODEL)
    return samples.select(
        "doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", F.sha2("pieces", 256).alias("pieces_sha256"), "round_trip"
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "linked"))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(every).alias("spans"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    audited = conversations.audited_conversations(conversations.damaged_turns(turns))
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(audited, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return found.select(F.col("id").alias("conv_id"), *numbers, *texts)


def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_bit_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bit_clusters.cluster_vectors(table(spark, folder, "embeddings"))


def cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of op13 one after the other: (id, i, x) are components, c holds the centroids of a round."""
    steps = [
        """s AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """p AS MATERIALIZED (SELECT vec_id AS id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM s, range(1, 65) AS r(i))""",
        f"""h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM s QUALIFY c < {k})""",
        """c0 AS MATERIALIZED (SELECT c, i, x FROM h JOIN p ON id = vec_id)""",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT p.id, c.c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{n} AS c ON p.i = c.i GROUP BY ALL)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)")
        if n < rounds:
            steps.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN"
                f" (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{n} JOIN p USING (id) GROUP BY ALL) AS m ON m.c = c.c AND m.i = c.i)"
            )
    steps.append(f"g AS (SELECT c, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(steps)}
        SELECT id AS vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
        FROM a{rounds} JOIN g USING (c)"""


QUERIES = [
    op1_toxicity, op2_decontamination, op3_ngram_jaccard, op4_language, op5_quality,
    op6_token_counts, op7_url_filter, op8_warc, op9_sentencepiece, op10_secrets,
    op11_conversation_repair, op12_exact_top_k, op13_bit_clusters,
]

SQL = {
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    "op12_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op13_bit_clusters": cluster_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
