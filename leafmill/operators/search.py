"""Corpus search and page extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import page_text, page_title, url_domain, word_count
from leafmill.operators.keywords import STOP_WORDS, tokens, without_stop_words, words
from leafmill.operators.ranking import top_k
from leafmill.session import materialise


#: Documents of a bitmap, and what share of them must have a word for its documents to be kept as bitmaps.
BITMAP, DENSE = 32768, 1 / 256


def search(
    queries: DataFrame, docs: DataFrame, doc_key: str = "doc_id", text: str = "text", max_results: int = 10, stop_words: list[str] = STOP_WORDS
) -> DataFrame:
    """Best documents per query: ``(query_id, doc_key, rank, score, total_results)``.

    ``queries`` (query_id, query). A document scores, over the query words it has, its share of the
    word times ln((1 + N) / (1 + df)) + 1. Only words of some query leave the scan of the corpus.

    Not every document with a word of a query is scored. The documents with the largest share of each word are scored first, and
    the score of the last of the best among these is a bound. Then the words' lists, largest share first, are all cut at one depth, the least at which
    what lies below the cuts cannot reach the bound together; only documents above some cut are scored. Where the cuts are is read off
    a histogram of each word's shares. The number of results is counted apart, in bitmaps of documents.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query"), stop_words))).alias("term"))
    vocabulary = wanted.select("term").distinct()
    # a table of few, large files would be cut into words by as many tasks
    rows = docs.select(doc_key, text).repartition(doc_key).select(doc_key, words(F.col(text)).alias("w"))
    terms = without_stop_words(F.col("w"), stop_words)
    # The length is computed below explode, once per document and not once per word; the number is fixed when the postings are written.
    sized = rows.select(doc_key, "w", F.size(terms).alias("n")).withColumn("no", F.monotonically_increasing_id())
    found = sized.select(doc_key, "no", "n", F.explode(terms).alias("term")).join(vocabulary, "term", "left_semi")
    postings = materialise(found.groupBy(doc_key, "no", "n", "term").agg(F.count("*").alias("tf")).withColumn("share", F.col("tf") / F.col("n")), "postings")
    n_docs = docs.count()
    idf = F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1
    freq = materialise(postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf), "frequencies")
    weighted = wanted.join(freq, "term")

    def scored(pairs: DataFrame) -> DataFrame:
        """Whole scores of (query_id, doc_key) pairs."""
        hits = pairs.join(weighted, "query_id").join(postings.select(doc_key, "term", "share"), [doc_key, "term"])
        return hits.groupBy("query_id", doc_key).agg(F.round(F.sum(F.col("share") * F.col("idf")), 6).alias("score"))

    lists = top_k(postings.select("term", doc_key, "share"), ["term"], [F.desc("share"), F.col(doc_key)], max_results, "place")
    first = scored(lists.join(weighted, "term").select("query_id", doc_key).distinct())
    kth = top_k(first, ["query_id"], [F.desc("score"), F.col(doc_key)], max_results).where(F.col("rank") == max_results)
    cuts = _cuts(postings, weighted, kth.select("query_id", F.col("score").alias("bound")), n_docs)
    candidates = postings.withColumn("step", _step()).join(cuts, "term").where(F.col("step") <= F.col("last_step")).select("query_id", doc_key).distinct()
    best = top_k(scored(candidates), ["query_id"], [F.desc("score"), F.col(doc_key)], max_results)
    return best.join(_result_counts(postings, freq.withColumn("dense", F.col("df") >= n_docs * DENSE), wanted), "query_id")


def _step() -> Column:
    """Shares in steps of a quarter of a power of two: 0 for a share of 1, more for less."""
    return F.floor(-4 * F.log2("share")).cast("int")


def _cuts(postings: DataFrame, weighted: DataFrame, bounds: DataFrame, n_docs: int) -> DataFrame:
    """``(query_id, term, last_step)``: the last step of each word's list above the cut of the query.

    Depths are powers of two. Below the cut at a depth every share is at most that of the next step; the depth of a query is
    the least one at which these shares, weighted, stay below its bound. A query without a bound takes the whole lists.
    """
    deepest = max(n_docs, 1).bit_length()
    steps = postings.withColumn("step", _step()).groupBy("term", "step").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy("step"))
    next_step = F.lead("step").over(Window.partitionBy("term").orderBy("step"))
    lists = steps.select("term", "step", above.alias("above"), next_step.alias("next_step"))
    # at a depth that takes in no whole step, the cut is above the first one
    first = steps.groupBy("term").agg(F.min("step").alias("next_step")).select("term", F.lit(-1).alias("step"), F.lit(0).cast("bigint").alias("above"), "next_step")
    depth = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    reached = lists.unionByName(first).withColumn("depth", depth).where(F.col("above") <= F.pow(F.lit(2.0), F.col("depth")))
    at_depth = reached.groupBy("term", "depth").agg(F.max(F.struct("step", "next_step")).alias("cut"))
    below = F.coalesce(F.pow(F.lit(2.0), -F.col("cut.next_step") / 4), F.lit(0.0))
    cut = materialise(weighted.join(at_depth.select("term", "depth", F.col("cut.step").alias("last_step"), below.alias("below")), "term"), "cuts")
    rest = cut.groupBy("query_id", "depth").agg(F.sum(F.col("below") * F.col("idf")).alias("rest"))
    # scores are rounded, so the bound gives way by one unit of the last place
    enough = rest.join(bounds, "query_id", "left").where((F.col("rest") < F.col("bound") - 1e-6) | (F.col("depth") == deepest))
    chosen = enough.groupBy("query_id").agg(F.min("depth").alias("depth"))
    return cut.join(chosen, ["query_id", "depth"]).select("query_id", "term", "last_step")


def _result_counts(postings: DataFrame, freq: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(query_id, total_results)``: how many documents have any of the words. The documents of a common word are bitmaps, which
    queries share; those of a rare one go into the bitmaps of its queries."""
    placed = postings.select("term", F.floor(F.col("no") / BITMAP).alias("block"), (F.col("no") % BITMAP).alias("bit")).join(freq.select("term", "dense"), "term")
    common = placed.where("dense").groupBy("term", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).join(wanted, "term").select("query_id", "block", "bits")
    rare = placed.where("NOT dense").join(wanted, "term").groupBy("query_id", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = common.unionByName(rare).groupBy("query_id", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).alias("total_results"))


def result_records(results: DataFrame, docs: DataFrame, doc_key: str, title: Column, url: Column, snippet: Column) -> DataFrame:
    """Search results with title, url, snippet and domain of the documents. Only documents that are results are looked at."""
    chosen = docs.join(results.select(doc_key).distinct(), doc_key, "left_semi")
    shown = chosen.select(doc_key, title.alias("title"), url.alias("url"), snippet.alias("snippet"))
    return results.join(shown, doc_key).withColumn("domain", url_domain(F.col("url")))


def snippet(text: Column, wanted: Column, around: int = 50) -> Column:
    """The part of a text around its first occurrence of any of the ``wanted`` words (lower case), as whole words; its beginning if there is none."""
    sign = r"[\p{L}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{sign})(?:"), F.array_join(wanted, "|"), F.lit(f")(?!{sign})"))
    pieces = F.split(F.lower(text), pattern, 2)
    place = F.when((F.size(wanted) > 0) & (F.size(pieces) > 1), F.length(pieces[0]) + 1).otherwise(1)
    return F.substr(text, F.greatest(place - around, F.lit(1)), F.lit(2 * around))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Every page with its domain, title, visible text and word count."""
    rest = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    text = pages.select(*rest, "page_id", "url", url_domain(F.col("url")).alias("domain"), page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("content"))
    return text.withColumn("word_count", word_count(F.col("content")))


def crawl(results: DataFrame, pages: DataFrame, max_pages: int = 5) -> DataFrame:
    """Content of the first ``max_pages`` result pages per query; ``results`` (query_id, page_id, rank)."""
    first = top_k(results.select("query_id", "page_id", "rank"), ["query_id"], [F.col("rank"), F.col("page_id")], max_pages, "place")
    # only the chosen pages are worth extracting, so the raw ones are joined
    return extract_pages(first.join(pages, "page_id"))


def pages_crawled(crawled: DataFrame) -> DataFrame:
    return crawled.groupBy("query_id").agg(F.count("*").alias("pages_crawled"))
