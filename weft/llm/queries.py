"""One query per operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard_join as jaccard
from weft.llm import line_dedup as lines
from weft.llm import max_score, mixing
from weft.llm import substring_dedup as substrings
from weft.llm.decontamination import find_contamination
from weft.llm.html_text import extract_text
from weft.llm.jaccard_join import jaccard_join
from weft.llm.secrets import scan_secrets
from weft.llm.substring_dedup import substring_dedup
from weft.llm.token_counts import token_counts
from weft.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    done = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_max_score_topk(spark, sf_dir):
    rows = max_score.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return max_score.max_score_top_k(rows.where("id % 100 = 0"), rows, 10)


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_benchmark_decontamination(spark, sf_dir):
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_max_score_topk, op3_substring_dedup, op4_toxicity, op5_benchmark_decontamination, op6_ngram_jaccard_join, op7_token_counts, op8_html_text, op9_secret_scan, op10_mix_sources)}
ORACLES: dict[str, str] = {"op1_line_dedup": lines.SQL, "op2_max_score_topk": max_score.SQL, "op3_substring_dedup": substrings.SQL, "op6_ngram_jaccard_join": jaccard.SQL, "op10_mix_sources": mixing.SQL}
