"""The registered queries of the operators. Importing this module registers them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import encode
from leafmill.llm.exact_dedup import DigestIndex
from leafmill.llm.language import learn, predict
from leafmill.llm.near_dup import links
from leafmill.llm.neighbours import nearest
from leafmill.llm.packing import pack
from leafmill.llm.pii import pseudonymise
from leafmill.llm.prefix_trie import numbered, prefix_trie, shared_heads
from leafmill.llm.quality import fit, score
from leafmill.llm.secret_links import CUT, FORMS, REACH, find_secrets, written
from leafmill.llm.secret_links import count as secret_count
from leafmill.llm.suffix_dedup import remove_repeats
from leafmill.llm.token_counts import token_counts
from leafmill.llm.turn_repair import damaged, digests, repair
from leafmill.plans.registry import query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: what splits documents into learning and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir))


@query("op2_exact_dedup", f"""
WITH digests AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS digest
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, digest AS text_sha256, false AS seen_before
FROM digests WINDOW same AS (PARTITION BY digest)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index, which goes after that."""
    index = DigestIndex.create(spark)
    decided = index.decide(documents(spark, sf_dir))
    index.drop()
    return decided


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, usable=remainder(3) != 1)
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query("op8_nearest_neighbours", """
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
           CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS INTEGER) AS rank
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0)
WHERE rank <= 20""")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    languages = learn(docs, remainder(4) != 2)
    return predict(docs.select("doc_id", "text"), languages).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


#: Only for the queries; whoever runs the operator brings a secret of their own.
PII_KEY = "key of the test queries"


@query("op7_pii_pseudonyms")
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, count_col="n_values")


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def _secret_spans_sql() -> str:
    """The same spans with DuckDB's functions: places from the lengths of the texts between matches, scopes by counting blank lines."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def places(number: int, pattern: str, keep: str) -> str:
        return f"""SELECT doc_id, ends - length(m) AS s, {number} AS k, ends AS e FROM (
            SELECT doc_id, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS ends FROM (
                SELECT doc_id, i, ms[i] AS m, gaps[i] AS gap FROM (
                    SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS ms, string_split_regex(t, {quoted(pattern)}) AS gaps FROM d),
                unnest(range(1, len(ms) + 1)) AS u(i))) WHERE {keep}"""

    finds = []
    for number, form in enumerate(FORMS):
        value = f"regexp_extract(m, {quoted(form.pattern)}, {form.group})" if form.group else "m"
        keep = " AND ".join([f"length({value}) >= {form.least}", *[f"regexp_matches(m, {quoted(sign)})" for sign in form.needs]])
        finds.append(places(number, form.pattern, keep))
    finds.append(places(len(FORMS), CUT, "true"))

    def kinds(role: str) -> str:
        return "(" + ", ".join(str(i) for i, f in enumerate(FORMS) if f.role == role) + ")"

    weak = min(i for i, f in enumerate(FORMS) if not f.strong)
    names = "[" + ", ".join(f"'{f.kind}'" for f in FORMS) + "]"
    written_sql = f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) {{}}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(finds)}),
scoped AS (SELECT *, sum(CASE WHEN k = {len(FORMS)} THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM found),
parts AS (SELECT * FROM scoped WHERE k < {len(FORMS)}),
beside AS (
    SELECT w.doc_id, w.s, w.k, w.e, bool_or(o.k IN {kinds('identifier')}) AS i, bool_or(o.k IN {kinds('secret')}) AS c, bool_or(o.k IN {kinds('endpoint')}) AS p
    FROM parts w JOIN parts o ON w.doc_id = o.doc_id AND w.scope = o.scope AND w.k >= {weak} AND o.s - w.e <= {REACH} AND w.s - o.e <= {REACH}
    GROUP BY w.doc_id, w.s, w.k, w.e),
spans AS (
    SELECT doc_id, s, k, e FROM parts WHERE k < {weak} UNION ALL
    SELECT doc_id, s, k, e FROM beside WHERE CASE WHEN k IN {kinds('secret')} THEN i OR p WHEN k IN {kinds('identifier')} THEN c ELSE i AND c END)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256({written_sql.format(f'FILTER (k < {weak})')}) AS base_sha256, {written_sql.format('FILTER (k IS NOT NULL)')} AS spans,
       count(*) FILTER (k >= {weak}) AS n_linked
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


@query("op11_secret_links", _secret_spans_sql())
def op11_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[secret_count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "linked"))).alias("spans"), F.size("linked").cast("bigint").alias("n_linked"))


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repair(damaged(given))
    every = given.select(F.struct("conv_id").alias("conv")).distinct()
    report = done.report.withColumn("conv", F.struct("conv_id")).drop("conv_id")
    sums = digests(done.turns).select(F.struct("conv_id").alias("conv"), "repaired_sha256")
    return every.join(report, "conv", "left").join(sums, "conv", "left").select(
        F.col("conv.conv_id"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
