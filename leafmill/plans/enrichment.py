"""Queries: text functions, keywords, search, pages, research summaries, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.attributes import try_json
from leafmill.operators import drafts as dr
from leafmill.operators import keywords as kw
from leafmill.operators import search as se
from leafmill.plans.inputs import DOCS_SQL, ctes, docs, table
from leafmill.plans.registry import query

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in kw.STOP_WORDS) + "]"
_TOKENS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains(" + STOP_SQL + ", w))"

# -- small functions ------------------------------------------------------------------------


@query("word_count", """SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0
  ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END::BIGINT AS words,
  len(string_split(text, ' '))::BIGINT AS pieces, 1::BIGINT AS empty_pieces FROM documents""")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.word_count(F.col("text")).alias("words"), tx.split_count(F.col("text")).alias("pieces"),
        tx.split_count(F.left("text", F.lit(0))).alias("empty_pieces"))


@query("parse_literal", """SELECT 'props' AS field, event_id, 'object' AS kind, props AS value FROM events
UNION ALL SELECT 'id', event_id, 'number', CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT 'type', event_id, CASE event_type WHEN 'view' THEN 'boolean' WHEN 'click' THEN 'null' WHEN 'error' THEN 'string' WHEN 'signup' THEN 'list' ELSE 'text' END,
  CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN NULL WHEN 'error' THEN 'a b' WHEN 'signup' THEN '[1,"x"]' ELSE event_type END FROM events""")
def parse_literal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spelled = F.expr("""CASE event_type WHEN 'view' THEN 'True' WHEN 'click' THEN 'None' WHEN 'error' THEN "'a b'" WHEN 'signup' THEN "[1, 'x']" ELSE event_type END""")
    rows = e.select("event_id", F.inline(F.array(
        F.struct(F.lit("props").alias("field"), F.col("props").alias("t")),
        F.struct(F.lit("id").alias("field"), F.col("event_id").cast("string").alias("t")),
        F.struct(F.lit("type").alias("field"), spelled.alias("t")))))
    value = tx.parse_literal(F.col("t"))
    back = F.regexp_replace(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)), '^\\{"k":', '{"k": ')
    return rows.select("field", "event_id", tx.literal_kind(F.col("t")).alias("kind"), F.nullif(back, F.lit("null")).alias("value"))


@query("requires_lines", """SELECT p_partkey, p_type AS extra, replace(p_name, ' ', '-') || '>=' || p_size AS requirement FROM part WHERE p_size > 10""")
def requires_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    quote = F.when(F.col("p_size") > 30, F.lit("'")).otherwise(F.lit('"'))
    marker = F.concat(F.lit("; python_version > '3' and Extra=="), quote, "p_type", quote)
    line = F.concat(F.lit("Requires-Dist: "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(">="), F.col("p_size").cast("string"),
                    F.when(F.col("p_size") > 10, marker).otherwise(F.lit("")))
    lines = p.select("p_partkey", line.alias("value")).unionByName(p.select("p_partkey", F.concat(F.lit("Name: "), "p_name").alias("value")))
    return tx.requires_lines(lines)


@query("requirement_name", """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS name FROM part""")
def requirement_name(spark, sf_dir):
    name = F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))
    tail = F.expr("""CASE p_type WHEN 'ECONOMY' THEN '>=1.2; extra == "x"' WHEN 'SMALL' THEN '[all]~=2.0' WHEN 'PROMO' THEN ' != 2.0,<3' WHEN 'STANDARD' THEN '===1' ELSE '' END""")
    return table(spark, sf_dir, "part").select("p_partkey", tx.requirement_name(F.concat(F.lit(" "), name, tail)).alias("name"))


@query("parse_kv", """SELECT event_id, event_type AS key, CASE WHEN value > 50 THEN 'a=b' ELSE props END AS value FROM events
UNION ALL SELECT event_id + 1000000000, NULL, NULL FROM events""")
def parse_kv(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = F.concat(F.lit(" "), "event_type", F.lit(' = "'), F.when(F.col("value") > 50, "a=b").otherwise(F.col("props")), F.lit('" '))
    key, value = tx.split_kv(F.col("t"))
    bare = e.select((F.col("event_id") + 1000000000).alias("event_id"), F.col("event_type").alias("t"))
    return e.select("event_id", given.alias("t")).unionByName(bare).select("event_id", key.alias("key"), value.alias("value"))


@query("parse_json_attr", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k,
  CASE WHEN event_type = 'error' THEN 'invalid JSON' END AS error FROM events""")
def parse_json_attr(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = try_json(F.when(F.col("event_type") == "error", F.concat("props", F.lit("]"))).otherwise(F.col("props")))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.when(v.isNull(), "invalid JSON").alias("error"))


@query("slug", "SELECT doc_id, lower(replace(split_part(text, chr(10), 1), ' ', '-')) AS slug FROM documents")
def slug(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.slug(F.col("title")).alias("slug"))


@query("url_domain", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.url_domain(F.col("url")).alias("domain"))


_TOPICS = ["License", "the of", "Copyright", "para", "NICHT", "dans"]


@query("topic_match", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{t.lower()}') THEN '{t}' END" for t in _TOPICS) + ") AS topics FROM documents")
def topic_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.topics(F.col("text"), _TOPICS), ",").alias("topics"))


# -- prompts --------------------------------------------------------------------------------

_TEMPLATE = "As {role}, turn {turn} of {{all}}: {text} ({role})"


@query("render_prompt", "SELECT conv_id, turn, 'As ' || role || ', turn ' || turn || ' of {all}: ' || text || ' (' || role || ')' AS prompt FROM conversations")
def render_prompt(spark, sf_dir):
    variables = {c: F.col(c) for c in ("role", "turn", "text")}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.render_prompt(_TEMPLATE, variables).alias("prompt"))


@query("stop_sequences", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role || '|END' WHEN 2 THEN 'A|' || role END AS stop FROM conversations""")
def stop_sequences(spark, sf_dir):
    as_variant = F.expr("""CASE turn % 4 WHEN 0 THEN CAST(role AS VARIANT) WHEN 1 THEN to_variant_object(array(role, 'END'))
                           WHEN 2 THEN to_variant_object(map('a', 'A', 'b', role)) END""")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.stop_sequences(as_variant), "|").alias("stop"))


@query("completion_requests", """SELECT conv_id, turn, 'small' AS model, text AS prompt, CASE WHEN role = 'user' THEN 0.5::DOUBLE END AS temperature,
  CASE WHEN turn > 1 THEN 100 + turn END::BIGINT AS max_tokens, CASE WHEN role = 'user' THEN 'user' END AS stop,
  role = 'user' AS has_temperature FROM conversations""")
def completion_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    is_user = F.col("role") == "user"
    stop = tx.stop_sequences(F.when(is_user, F.col("role").cast("variant")))
    request = tx.completion_request(F.lit("small"), F.col("text"), temperature=F.when(is_user, F.lit(0.5)),
                                    max_tokens=F.when(F.col("turn") > 1, F.col("turn") + 100), stop=stop)
    v = F.parse_json(request)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return c.select(
        "conv_id", "turn", get("$.model", "string").alias("model"), get("$.messages[0].content", "string").alias("prompt"),
        get("$.temperature", "double").alias("temperature"), get("$.max_tokens", "bigint").alias("max_tokens"),
        get("$.stop[0]", "string").alias("stop"), F.contains(request, F.lit('"temperature":')).alias("has_temperature"))


# -- keywords -------------------------------------------------------------------------------

SCORED_SQL = f"""tokenised AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
cand AS (SELECT doc_id, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM tokenised),
flat AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM cand),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM flat GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT doc_id, term, round(tf / n * (ln((1 + (SELECT count(*) FROM documents)::DOUBLE) / (1 + df)) + 1), 9) AS score FROM tf JOIN freq USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored)"""


def _scored(spark, sf_dir, **options):
    return kw.score_candidates(table(spark, sf_dir, "documents"), "doc_id", "text", **options)


@query("keyword_extract", ctes(SCORED_SQL) + "SELECT doc_id, rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def keyword_extract(spark, sf_dir):
    top = kw.top_keywords(_scored(spark, sf_dir, best=10), "doc_id", 10)
    return top.select("doc_id", "rank", "term", F.round("score", 6).alias("score"))


def _jaccard(a: str, b: str) -> str:
    """Likeness of two terms of one or two words."""
    a1, b1 = f"split_part({a}, ' ', 1)", f"split_part({b}, ' ', 1)"
    a2, b2 = (f"nullif(nullif(split_part({t}, ' ', 2), ''), split_part({t}, ' ', 1))" for t in (a, b))
    shared = f"(CAST({a1} = {b1} OR coalesce({a1} = {b2}, false) AS INT) + CAST(coalesce({a2} = {b1}, false) OR coalesce({a2} = {b2}, false) AS INT))"
    return f"({shared} / (2 + CAST({a2} IS NOT NULL AS INT) + CAST({b2} IS NOT NULL AS INT) - {shared}))"


@query("keyword_mmr", ctes(SCORED_SQL, f"""rel AS (SELECT doc_id, term, score, score / max(score) OVER (PARTITION BY doc_id) AS rel, rank FROM ranked),
p1 AS (SELECT doc_id, term AS t1, score FROM rel WHERE rank = 1),
g2 AS (SELECT r.doc_id, r.term, r.score, r.rel, p1.t1, {_jaccard('r.term', 'p1.t1')} AS s1 FROM rel r JOIN p1 USING (doc_id) WHERE r.rank > 1),
p2 AS (SELECT doc_id, term AS t2, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round((1 - 0.7) * rel - 0.7 * s1, 9) DESC, term) AS rn FROM g2) WHERE rn = 1),
g3 AS (SELECT g.doc_id, g.term, g.score, g.rel, greatest(s1, {_jaccard('g.term', 'p2.t2')}) AS s FROM g2 g JOIN p2 USING (doc_id) WHERE g.term <> p2.t2),
p3 AS (SELECT doc_id, term AS t3, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round((1 - 0.7) * rel - 0.7 * s, 9) DESC, term) AS rn FROM g3) WHERE rn = 1)""")
    + """SELECT doc_id, 1 AS rank, t1 AS term, round(score, 6) AS score FROM p1 UNION ALL SELECT doc_id, 2, t2, round(score, 6) FROM p2
UNION ALL SELECT doc_id, 3, t3, round(score, 6) FROM p3""")
def keyword_mmr(spark, sf_dir):
    chosen = kw.mmr_keywords(_scored(spark, sf_dir, apart=(3, 0.7)), "doc_id", top_n=3, diversity=0.7)
    return chosen.select("doc_id", "rank", "term", F.round("score", 6).alias("score"))


@query("keyword_maxsum", ctes(SCORED_SQL, f"""best AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS size FROM ranked WHERE rank <= 12),
pair AS (SELECT a.doc_id, a.rank AS i, b.rank AS j, {_jaccard('a.term', 'b.term')} AS s FROM best a JOIN best b ON a.doc_id = b.doc_id AND a.rank < b.rank),
trio AS (SELECT p.doc_id, p.i, p.j, q.j AS k, round(p.s + q.s + r.s, 6) AS s FROM pair p JOIN pair q ON p.doc_id = q.doc_id AND p.j = q.i
  JOIN pair r ON r.doc_id = p.doc_id AND r.i = p.i AND r.j = q.j),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, i, j, k) AS rn FROM trio) WHERE rn = 1),
long AS (SELECT doc_id, 1 AS rank, i AS at FROM pick UNION ALL SELECT doc_id, 2, j FROM pick UNION ALL SELECT doc_id, 3, k FROM pick
  UNION ALL SELECT doc_id, rank, rank FROM best WHERE size < 3)""")
    + "SELECT l.doc_id, l.rank, b.term, round(b.score, 6) AS score FROM long l JOIN best b ON b.doc_id = l.doc_id AND b.rank = l.at")
def keyword_maxsum(spark, sf_dir):
    chosen = kw.maxsum_keywords(_scored(spark, sf_dir, best=12), "doc_id", top_n=3, nr_candidates=12)
    return chosen.select("doc_id", "rank", "term", F.round("score", 6).alias("score"))


@query("keyword_highlight", f"""WITH tokenised AS (SELECT doc_id, {_TOKENS.format('text')} AS terms FROM documents),
flat AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM tokenised),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM flat GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ranked AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf / n * (ln((1 + (SELECT count(*) FROM documents)::DOUBLE) / (1 + df)) + 1), 9) DESC, term) AS rank
  FROM tf JOIN freq USING (term)),
words AS (SELECT doc_id, list(term) AS kws FROM ranked WHERE rank <= 3 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN kws IS NULL THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
  lambda t: CASE WHEN list_contains(kws, lower(t)) THEN '**' || t || '**' ELSE t END), '') END AS text
FROM documents d LEFT JOIN words USING (doc_id)""")
def keyword_highlight(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    top = kw.top_keywords(_scored(spark, sf_dir, ngram_range=(1, 1), best=3), "doc_id", 3)
    words = top.groupBy("doc_id").agg(F.collect_list("term").alias("kws"))  # three per document
    marked = d.join(words, "doc_id", "left")
    kws = F.coalesce("kws", F.expr("CAST(array() AS ARRAY<STRING>)"))
    return marked.select("doc_id", kw.highlight(F.col("text"), kws).alias("text"))


# -- search and pages -----------------------------------------------------------------------


@query("corpus_search", f"""WITH terms AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
flat AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM terms),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM flat GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
wanted AS (SELECT query_id, list(term) AS words FROM q GROUP BY query_id),
scored AS (SELECT query_id, doc_id, round(sum(tf / n * (ln((1 + (SELECT count(*) FROM documents)::DOUBLE) / (1 + df)) + 1)), 6) AS score
  FROM q JOIN tf USING (term) JOIN freq USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_results FROM scored)
SELECT query_id, doc_id, rank, score, total_results, split_part(text, chr(10), 1) AS title, 'https://' || source || '.example.org/' || doc_id AS url, source || '.example.org' AS domain,
  substr(text, greatest(greatest(length(regexp_extract(' ' || lower(text) || ' ', '(?s)^(.*?[^\\p{{L}}\\p{{N}}_])(?:' || list_aggregate(words, 'string_agg', '|') || ')[^\\p{{L}}\\p{{N}}_]', 1)), 1) - 50, 1), 100) AS snippet
FROM ranked JOIN documents USING (doc_id) JOIN wanted USING (query_id) WHERE rank <= 10""")
def corpus_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    results = se.search(queries, d, max_results=10)
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))
    wanted = queries.select("query_id", F.array_distinct(kw.tokens(F.col("query"))).alias("wanted"))
    shown = se.result_records(results.join(wanted, "query_id"), d, "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)), url, F.col("text"))
    part = se.snippet(F.col("snippet"), F.col("wanted"))
    return shown.select("query_id", "doc_id", "rank", "score", "total_results", "title", "url", "domain", part.alias("snippet"))


def _unescape_sql(column: str) -> str:
    for entity, plain in tx.ENTITIES:
        column = f"replace({column}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return column


def _strip_sql() -> str:
    column = "html"
    for p, flags in (("<!--.*?-->", "gs"), ("<script[^>]*>.*?</script>", "gsi"), ("<style[^>]*>.*?</style>", "gsi"), ("<title[^>]*>.*?</title>", "gsi"), ("<[^>]*>", "gs")):
        column = f"regexp_replace({column}, '{p}', ' ', '{flags}')"
    return f"trim(regexp_replace({_unescape_sql(column)}, '\\s+', ' ', 'g'))"


EXTRACTED_SQL = f"""extracted AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain,
  trim({_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title, {_strip_sql()} AS content FROM pages)"""
_WORDS = "CASE WHEN content = '' THEN 0 ELSE len(string_split(content, ' ')) END::BIGINT"


@query("page_extract", ctes(EXTRACTED_SQL) + f"SELECT page_id, domain, title, content, {_WORDS} AS word_count FROM extracted")
def page_extract(spark, sf_dir):
    return se.extract_pages(table(spark, sf_dir, "pages")).drop("url")


_TLD = "regexp_extract(url, '^[a-z]+://[^/?#:]*\\.([a-z]+)', 1)"


@query("page_crawl", ctes(EXTRACTED_SQL) + f"""SELECT query_id, page_id, place, title, {_WORDS} AS word_count FROM (
  SELECT {_TLD} AS query_id, page_id, row_number() OVER (PARTITION BY {_TLD} ORDER BY length(url), page_id) AS place FROM pages) JOIN extracted USING (page_id)
WHERE place <= 5""")
def page_crawl(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    # Results of one search: the pages under one top-level domain, shortest address first.
    results = p.select(F.regexp_extract("url", r"^[a-z]+://[^/?#:]*\.([a-z]+)", 1).alias("query_id"), "page_id", F.length("url").alias("rank"))
    return se.crawl(results, p, 5).select("query_id", "page_id", "place", "title", "word_count")


# -- research and drafts --------------------------------------------------------------------

RESEARCH_SQL = """findings AS (SELECT conv_id AS doc_id, turn AS no, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS title, text AS summary,
  CASE WHEN turn > 2 THEN role END AS source, CASE WHEN turn > 2 THEN turn / 10 END AS relevance, string_split(text, chr(10))[2:] AS key_points
  FROM conversations WHERE role <> 'user'),
web AS (SELECT conv_id AS doc_id, turn AS no, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS title, text AS snippet,
  CASE WHEN turn > 1 THEN 'https://' || role || '.example.org/' || conv_id END AS url, CASE WHEN turn > 1 THEN role || '.example.org' END AS domain
  FROM conversations WHERE role = 'user')"""


def _research(spark, sf_dir):
    """Turns of a conversation as the results of its document: users give web results, others findings."""
    c = table(spark, sf_dir, "conversations")
    title = F.when(F.contains("text", F.lit("\n")), F.split_part("text", F.lit("\n"), F.lit(1)))
    base = [F.col("conv_id").alias("doc_id"), F.col("turn").alias("no"), title.alias("title")]
    findings = c.where("role <> 'user'").select(
        *base, F.col("text").alias("summary"), F.when(F.col("turn") > 2, F.col("role")).alias("source"),
        F.when(F.col("turn") > 2, F.col("turn") / 10).alias("relevance"), F.expr(r"slice(split(text, '\n'), 2, size(split(text, '\n')))").alias("key_points"))
    url = F.when(F.col("turn") > 1, F.concat(F.lit("https://"), "role", F.lit(".example.org/"), F.col("conv_id").cast("string")))
    web = c.where("role = 'user'").select(*base, F.col("text").alias("snippet"), url.alias("url"), tx.url_domain(url).alias("domain"))
    return findings, web


def _no_bucket():
    return [F.expr("no DIV 100")]


SUMMARY_LINES_SQL = """lines AS (
  SELECT DISTINCT doc_id, 0 AS part, 0 AS no, 0 AS i, 'GPT Researcher Findings:' AS line FROM findings
  UNION ALL SELECT doc_id, 1, no, 0, '- ' || coalesce(title, 'Unknown') || ': ' || summary FROM findings
  UNION ALL SELECT doc_id, 1, no, i, '  * ' || key_points[i] FROM (SELECT *, unnest(generate_series(1, len(key_points))) AS i FROM findings)
  UNION ALL SELECT DISTINCT doc_id, 2, 0, 0, chr(10) || 'Web Research Findings:' FROM web
  UNION ALL SELECT doc_id, 3, no, 0, '- ' || coalesce(title, 'Unknown') || ': ' || snippet FROM web),
summary AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, no, i) AS line_no, line FROM lines)"""


@query("consolidate_research", """SELECT conv_id AS doc_id, turn, 'Research Results: ' || CASE WHEN role = 'user' THEN role ELSE 'Unknown Query' END AS title,
  'Research completed for: ' || CASE WHEN role = 'user' THEN role ELSE 'unknown query' END || chr(10) || chr(10) || CASE WHEN turn > 1 THEN text ELSE 'No summary available' END AS content,
  'research_results' AS type FROM conversations""")
def consolidate_research(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.struct("conv_id", "turn").alias("doc_id"), F.when(F.col("role") == "user", F.col("role")).alias("query"), F.when(F.col("turn") > 1, F.col("text")).otherwise("").alias("summary"))
    return dr.consolidate(rows).select(F.col("doc_id.conv_id").alias("doc_id"), F.col("doc_id.turn").alias("turn"), "title", "content", "type")


@query("research_summary", ctes(RESEARCH_SQL, SUMMARY_LINES_SQL) + "SELECT doc_id, line_no, line FROM summary")
def research_summary(spark, sf_dir):
    return dr.research_summary(*_research(spark, sf_dir), _no_bucket())


@query("extract_sources", ctes(RESEARCH_SQL) + """SELECT doc_id, no, 'gpt_researcher' AS type, coalesce(title, 'Unknown') AS title, coalesce(source, 'GPT Researcher') AS source,
  coalesce(relevance, 0.0) AS relevance_score, NULL AS url, NULL AS domain FROM findings
UNION ALL SELECT doc_id, no, 'web_search', coalesce(title, 'Unknown'), NULL, NULL, coalesce(url, ''), coalesce(domain, 'Unknown') FROM web""")
def extract_sources(spark, sf_dir):
    return dr.extract_sources(*_research(spark, sf_dir))


POINTS_SQL = """points AS (SELECT doc_id, pos, point FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, i) AS pos, point FROM (
  SELECT doc_id, no, unnest(key_points) AS point, generate_subscripts(key_points, 1) AS i FROM findings)) WHERE pos <= 10)"""


@query("key_points", ctes(RESEARCH_SQL, POINTS_SQL) + "SELECT doc_id, pos, point FROM points")
def key_points(spark, sf_dir):
    return dr.key_points(_research(spark, sf_dir)[0])


_TERMS, _BOTH, _JOINED, _DEFAULT = ("en", "que"), "Both at once", "{}: A Guide", "No Terms"
TITLES_SQL = """titles AS (SELECT doc_id, CASE WHEN bool_or(coalesce(contains(title, 'en') AND contains(title, 'que'), false)) THEN 'Both at once'
  WHEN count(t) > 0 THEN string_agg(t, ' vs. ' ORDER BY no) || ': A Guide' ELSE 'No Terms' END AS title
  FROM (SELECT *, CASE WHEN contains(title, 'en') THEN 'en' WHEN contains(title, 'que') THEN 'que' END AS t FROM findings) GROUP BY doc_id)"""


@query("title_rule", ctes(RESEARCH_SQL, TITLES_SQL) + "SELECT doc_id, title FROM titles")
def title_rule(spark, sf_dir):
    return dr.title_rule(_research(spark, sf_dir)[0], _TERMS, _BOTH, _JOINED, _DEFAULT)


_LINE_WORDS = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))"


@query("draft_record", ctes(RESEARCH_SQL, SUMMARY_LINES_SQL, POINTS_SQL, TITLES_SQL) + f""",
l AS (SELECT doc_id, sum({_LINE_WORDS})::BIGINT AS actual_length, count(*) AS lines FROM summary GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS sources FROM (SELECT doc_id FROM findings UNION ALL SELECT doc_id FROM web) GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(point, '|' ORDER BY pos) AS key_points FROM points GROUP BY doc_id)
SELECT doc_id, title, 'professional' AS style, 1500 AS target_length, actual_length, lines, sources, 'draft' AS status, key_points
FROM titles JOIN l USING (doc_id) JOIN s USING (doc_id) LEFT JOIN p USING (doc_id)""")
def draft_record(spark, sf_dir):
    findings, web = _research(spark, sf_dir)
    return dr.draft_records(dr.research_summary(findings, web, _no_bucket()), dr.extract_sources(findings, web), dr.key_points(findings),
                            dr.title_rule(findings, _TERMS, _BOTH, _JOINED, _DEFAULT))
