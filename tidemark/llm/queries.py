"""The operators on the driver's tables, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near-equal bytes. The old layout is 16 shards by source; a source may be hot."""
    from tidemark.llm.sharding import reshard

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(16)).alias("home"),
    )
    out = reshard(rows, F.col("home"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality posterior; hosts are sources, paths are sources with languages."""
    from tidemark.llm.quality import classify

    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from tidemark.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from tidemark.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hmm import score

    return score(table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import repair

    return repair(table(spark, sf_dir, "conversations"))


def op2_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours of every hundredth vector among all others."""
    from tidemark.llm.mih import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pstable import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the line that stands for it."""
    from tidemark.llm.lines import WHOLE, fuzzy_lines

    return fuzzy_lines(table(spark, sf_dir, "documents"), **WHOLE)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_mih, op3_minhash, op4_quality, op5_bpe, op6_pstable, op7_packing, op8_lines, op9_hmm, op10_chat)}
_LINKED = """r AS (SELECT id, id AS x FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.x), m AS (SELECT id, min(x) AS component_id FROM r GROUP BY 1)"""

#: The exact results; the other operators are learned, solved or encoded, and tested against brute force instead.
ORACLE = {
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
u AS (SELECT id, unnest(s) AS x FROM n), c AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * i >= 80 * (len(p.s) + len(q.s) - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_LINKED}
SELECT n.id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, n.id = component_id AS kept FROM n JOIN m USING (id)""",
    "op6_pstable": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.93), k AS (SELECT a, count(*) AS c FROM e GROUP BY 1), {_LINKED}
SELECT n.id AS vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component_id, n.id = component_id AS kept FROM n JOIN m USING (id) LEFT JOIN k ON k.a = n.id""",
}
