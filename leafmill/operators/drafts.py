"""Research consolidation and draft records.

``findings`` (doc_id, no, title, summary, source, relevance, key_points ARRAY) and ``web``
(doc_id, no, title, snippet, url, domain) hold the results of a document in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import word_count
from leafmill.operators.ranking import running_number, top_k

# The headings and defaults of a research summary.
FINDINGS_HEADING = "GPT Researcher Findings:"
WEB_HEADING = "\nWeb Research Findings:"
UNKNOWN, NO_SUMMARY, NO_SNIPPET = "Unknown", "No summary", "No snippet"
DEFAULT_SOURCE = "GPT Researcher"


def consolidate(results: DataFrame) -> DataFrame:
    """Document record of a research result (doc_id, query, summary), with defaults for missing parts."""
    given = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return results.select(
        "doc_id",
        F.concat(F.lit("Research Results: "), given("query", "Unknown Query")).alias("title"),
        F.concat(F.lit("Research completed for: "), given("query", "unknown query"), F.lit("\n\n"), given("summary", "No summary available")).alias("content"),
        F.lit("research_results").alias("type"),
    )


def _finding_line() -> Column:
    return F.concat(F.lit("- "), F.coalesce("title", F.lit(UNKNOWN)), F.lit(": "), F.coalesce("summary", F.lit(NO_SUMMARY)))


def _web_line() -> Column:
    return F.concat(F.lit("- "), F.coalesce("title", F.lit(UNKNOWN)), F.lit(": "), F.coalesce("snippet", F.lit(NO_SNIPPET)))


def research_summary(findings: DataFrame, web: DataFrame, bucket: list[Column]) -> DataFrame:
    """The summary of every document line by line: ``(doc_id, line_no, line)``.

    Lines stay rows, so a document with very many results is not gathered in one task. ``bucket`` is
    a coarser form of the result number ``no``.
    """
    point_lines = F.transform(F.coalesce("key_points", F.expr("CAST(array() AS ARRAY<STRING>)")), lambda p: F.concat(F.lit("  * "), p))
    body = findings.select("doc_id", F.lit(1).alias("part"), "no", F.posexplode(F.concat(F.array(_finding_line()), point_lines)).alias("i", "line"))
    webs = web.select("doc_id", F.lit(3).alias("part"), "no", F.lit(0).alias("i"), _web_line().alias("line"))
    head = lambda df, part, text: df.select("doc_id").distinct().select(
        "doc_id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("no"), F.lit(0).alias("i"), F.lit(text).alias("line"))
    lines = head(findings, 0, FINDINGS_HEADING).unionByName(body).unionByName(head(web, 2, WEB_HEADING)).unionByName(webs)
    numbered = running_number(lines, ["doc_id"], ["part", "no", "i"], [F.col("part"), *bucket], "line_no")
    return numbered.select("doc_id", "line_no", "line")


def extract_sources(findings: DataFrame, web: DataFrame) -> DataFrame:
    """Both kinds of results as sources with their type and defaults."""
    a = findings.select(
        "doc_id", "no", F.lit("gpt_researcher").alias("type"), F.coalesce("title", F.lit(UNKNOWN)).alias("title"),
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"), F.coalesce("relevance", F.lit(0.0)).alias("relevance_score"))
    b = web.select(
        "doc_id", "no", F.lit("web_search").alias("type"), F.coalesce("title", F.lit(UNKNOWN)).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("domain", F.lit(UNKNOWN)).alias("domain"))
    return a.unionByName(b, allowMissingColumns=True)


def key_points(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` key points of a document in result order: ``(doc_id, pos, point)``."""
    points = findings.select("doc_id", "no", F.posexplode(F.slice("key_points", F.lit(1), F.lit(limit))).alias("i", "point"))
    return top_k(points, ["doc_id"], [F.col("no"), F.col("i")], limit, "pos").select("doc_id", "pos", "point")


#: Terms of a title that are joined in one piece.
TITLE_PIECE = 1000


def title_pieces(findings: DataFrame, terms: tuple[str, str], bucket: list[Column]) -> DataFrame:
    """The terms found in the result titles of a document, one per result in order, joined in pieces: ``(doc_id, piece_no, piece)``.

    Pieces stay rows and hold a bounded number of terms, whatever the number of results. ``bucket`` is a coarser form of the result number ``no``.
    """
    first, second = terms
    term = F.when(F.contains("title", F.lit(first)), first).when(F.contains("title", F.lit(second)), second)
    found = findings.select("doc_id", "no", term.alias("term")).where("term IS NOT NULL")
    numbered = running_number(found, ["doc_id"], ["no"], bucket, "k")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"])
    return numbered.groupBy("doc_id", F.floor((F.col("k") - 1) / TITLE_PIECE).alias("piece_no")).agg(F.array_join(in_order, " vs. ").alias("piece"))


def title_rule(findings: DataFrame, terms: tuple[str, str], both: str, joined: str, default: str, bucket: list[Column] | None = None) -> DataFrame:
    """Title per document: ``both`` if one result title holds both terms; else ``joined`` with the
    terms found, one per result in order, as its ``{}``; else ``default``.

    The terms come in the pieces of ``title_pieces``; those of documents whose title is ``both`` are not put together.
    """
    first, second = terms
    has_both = F.coalesce(F.contains("title", F.lit(first)) & F.contains("title", F.lit(second)), F.lit(False))
    before, after = joined.split("{}")
    per_doc = findings.groupBy("doc_id").agg(F.bool_or(has_both).alias("both"))
    open_ = findings.join(per_doc.where("NOT both"), "doc_id", "left_semi")
    pieces = title_pieces(open_, terms, bucket or [F.lit(0)]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias("pieces"))
    names = F.array_join(F.transform("pieces", lambda x: x["piece"]), " vs. ")
    title = F.when(F.col("both"), F.lit(both)).when(F.col("pieces").isNotNull(), F.concat(F.lit(before), names, F.lit(after))).otherwise(F.lit(default))
    return per_doc.join(pieces, "doc_id", "left").select("doc_id", title.alias("title"))


def draft_records(summary: DataFrame, sources: DataFrame, points: DataFrame, titles: DataFrame, style: str = "professional", target_length: int = 1500) -> DataFrame:
    """One record per document: title, length in words of its content, sources and key points.

    The content is the research summary, kept in lines; its words are counted line by line.
    """
    lengths = summary.groupBy("doc_id").agg(F.sum(word_count(F.col("line"))).alias("actual_length"), F.count("*").alias("lines"))
    n_sources = sources.groupBy("doc_id").agg(F.count("*").alias("sources"))
    top = points.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "point"))).alias("p"))  # at most ten per document
    return (
        titles.join(lengths, "doc_id", "left").join(n_sources, "doc_id", "left").join(top, "doc_id", "left")
        .select("doc_id", "title", F.lit(style).alias("style"), F.lit(target_length).alias("target_length"), "actual_length", "lines", "sources",
                F.lit("draft").alias("status"), F.array_join(F.transform("p", lambda x: x["point"]), "|").alias("key_points"))
    )
