"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=2)
    digest = F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near_items", "near_items")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import assemble, capture_table, read_records, write_archives

    return capture_table(assemble(read_records(write_archives(table(spark, sf_dir, "pages")))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, learn

    documents = table(spark, sf_dir, "documents")
    found = identify(documents, learn(documents))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), digest.alias("base_sha256"), "spans")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle_words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): the positions of the lines that go, ascending, comma-joined."""
    from .line_dedup import repeated_lines, row_key

    documents = table(spark, sf_dir, "documents")
    some_id = F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id")
    gone = repeated_lines(documents).groupBy(some_id, "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    rows = documents.select("doc_id", some_id, row_key().alias("row"), n_lines.cast("long").alias("n_lines")).join(gone, ["id", "row"], "left")
    dropped = F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit(""))
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import remainder, score

    documents = table(spark, sf_dir, "documents")
    found = score(documents, documents.where(remainder() != 1))
    return found.select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op10_language_model": op10_language_model,
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

ORACLE_SQL: dict[str, str] = {
    "op4_warc": f"""
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS best
              FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
}
