"""The registered queries of this subpackage, each over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import (
    alignment,
    bpe,
    decontamination,
    extraction,
    jaccard,
    lines,
    lm,
    pii,
    quality,
    runs,
    simhash,
    toxicity,
    warc,
)

# A rank file every executor can read, and the pattern that goes with it.
RANKS = "byte_bpe_50k.tiktoken"
# For these tables only: a real corpus takes its key from a secret store.
PSEUDONYM_KEY = "public test key"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def tokenizer_pair() -> tuple[str, str, str]:
    import public_tokenizers

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return *map(public_tokenizers.path, names), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    scored = lm.score(table(spark, sf, "documents"))
    return scored.withColumn("score", F.round("score", 4)).withColumn("mean_score", F.round("mean_score", 6))


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.digests(table(spark, sf, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.digests(table(spark, sf, "documents"))


def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), *tokenizer())


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf, "documents"), PSEUDONYM_KEY)


def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extraction.extract(pages, extraction.train(pages))


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each page as a full response and as a later visit answered "not modified".

    A visit spells the URL its own way and comes up to six laps after the page's
    capture, some before it; one in nine has an etag of another version.
    """
    page = F.col("page_id")
    body = F.md5(F.coalesce("html", F.lit("")))
    etag = F.concat(F.lit('"'), body, F.lit('"'))
    response = F.create_map(
        F.lit("etag"), etag,
        F.lit("date"), (page * 10).cast("string"),
        F.lit("content-type"), F.lit("text/html"),
        F.lit("content-length"), F.octet_length("html").cast("string"),
    )
    visit_time = page * 10 + (page % 7 - 1) * 5000 + 5
    visit = F.create_map(
        F.lit("etag"), F.when(page % 9 == 4, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag)),
        F.lit("date"), visit_time.cast("string"),
        F.lit("content-length"), F.lit("0"),
    )
    spelled = F.concat(
        F.regexp_extract("url", r"^([a-z]+://)", 1),
        F.upper(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1),
        F.lit("#again"),
    )
    responses = pages.select(
        (page * 2).alias("record_id"), "url", (page * 10).alias("captured_at"),
        response.alias("headers"), body.alias("digest"),
    )
    revisits = pages.select(
        (page * 2 + 1).alias("record_id"), spelled.alias("url"), visit_time.alias("captured_at"),
        visit.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return responses, revisits


def op9_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    resolved = warc.resolve(*captures(table(spark, sf, "pages")))
    names = ["etag", "date", "content-type", "content-length"]
    return resolved.select(
        "revisit_id", "url", "response_id", "status", "digest",
        *[F.col("headers")[name].alias(name.replace("-", "_")) for name in names],
    )


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def repeating(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with every tenth text, by the hash of its id, made periodic.

    Its n words from word a = g % n on, where g is a tenth of the hash, give way to repeats
    of the p = 1 + (n - a) div (3 + g % 8) words that begin there.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, first, period = F.size("words"), F.col("first"), F.col("period")
    numbers = F.sequence(F.lit(0), n - 1)
    spread = F.transform(
        numbers, lambda i: F.get("words", F.when(i < first, i).otherwise(first + (i - first) % period))
    )
    return (
        docs.select("doc_id", "text", hashed.alias("hash"))
        .withColumn("words", F.when(F.col("hash") % 10 == 0, words))
        .withColumn("first", (F.expr("hash div 10") % n).cast("int"))
        .withColumn("period", F.expr("1 + (size(words) - first) div (3 + hash div 10 % 8)").cast("int"))
        .select("doc_id", F.when(n > 0, F.array_join(spread, " ")).otherwise(F.col("text")).alias("text"))
    )


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.digests(repeating(table(spark, sf, "documents")))


def op12_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.connected(table(spark, sf, "documents"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.agreement(table(spark, sf, "documents"), *tokenizer_pair())


QUERIES = {
    query.__name__: query
    for query in (
        op1_lm_scoring,
        op2_line_dedup,
        op3_simhash_near_dedup,
        op4_toxicity,
        op5_quality_rules,
        op6_byte_bpe,
        op7_pii,
        op8_html_extraction,
        op9_warc_revisits,
        op10_benchmark_decontamination,
        op11_periodic_runs,
        op12_ngram_jaccard_join,
        op13_token_alignment,
    )
}
