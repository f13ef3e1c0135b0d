"""The registered queries of this folder and their SQL. Parameters are the production ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near, nearest, pack, quality, sequences, shards, substring, suffix, warc


def tokenizer() -> str:
    """The public tokenizer file that the packing and output queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; trained on six of seven folds."""
    return suffix.score_texts(table(spark, sf_dir, "documents"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at a similarity of 0.75 of 5-word shingle sets, every document."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of all documents."""
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows, every document."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, every document."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents for the production targets."""
    made = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return made.select("_doc.doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate", "copies", "residual")


def op8_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the log-likelihood ratio of all documents."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "rules.*")


def op9_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow stream files of 2048-token sequences, written and read back, every document."""
    return sequences.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100; candidates: every other row."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


#: Fixed value: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"
#: Shingle sets of lower-cased words (a shorter text is one shingle), all pairs that share one, links, and the smallest id reachable.
NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON v = d.doc_id"""
#: Pages by digest; of long equal payloads the one with the smallest id answers for the others.
WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM p LEFT JOIN f USING (d)"""
#: Windows of 13 words, the smallest document of each, and the words that an earlier document's window covers.
REPEATS_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT x, min(doc_id) AS f FROM x GROUP BY 1), g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM x JOIN f USING (x) WHERE f < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Where SQL states the whole result; elsewhere there are hashes, tokenizers, fits or an index's approximation."""
    return {"op2_chosen_path": NEAR_SQL, "op3_warc_dictionary": WARC_SQL, "op5_substring_dedup": REPEATS_SQL}
