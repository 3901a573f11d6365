"""Queries: lookups, filters and projections of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leafmill.functions.attributes import attribute
from leafmill.operators import filters as flt
from leafmill.operators import projections as prj
from leafmill.operators.ranking import running_number
from leafmill.operators.requirements import AttributeCheck, ListCheck, attribute_check, list_check
from leafmill.plans.inputs import DOC_REFS_SQL, DOC_TAGS_SQL, DOCS_SQL, FILE_REFS_SQL, NUMBERED_STAGES_SQL, STAGES_SQL, ctes, docs, stages
from leafmill.plans.registry import query

D = ctes(DOCS_SQL)
DT = ctes(DOCS_SQL, DOC_TAGS_SQL)


# -- lookup and where -----------------------------------------------------------------------


@query("find_by_id", D + """, copies AS (
  SELECT id, status, lang, title FROM docs
  UNION ALL SELECT CAST(doc_id // 2 AS VARCHAR), status, lang, title FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'inbox' THEN 0 WHEN 'active' THEN 1
    WHEN 'done' THEN 2 WHEN 'blocked' THEN 3 ELSE 4 END, lang, title) AS rn FROM copies)
SELECT id, status FROM ranked WHERE rn = 1 AND id IN ('0', '7', '42', '55', '101', '190', '777777')""")
def find_by_id(spark, sf_dir):
    # Every document also under half its number, so that one id lies under several statuses.
    d = docs(spark, sf_dir).select("doc_id", "id", "status")
    copies = d.select("id", "status").unionByName(d.select(F.expr("CAST(doc_id DIV 2 AS STRING)").alias("id"), "status"))
    return flt.find(copies, ["0", "7", "42", "55", "101", "190", "777777"])


@query("where_status", D + "SELECT id, lang FROM docs WHERE status = 'active'")
def where_status(spark, sf_dir):
    return flt.where(docs(spark, sf_dir), status="active").select("id", "lang")


@query("where_doc_ref", ctes(DOC_REFS_SQL) + "SELECT DISTINCT id FROM doc_refs WHERE key = 'related_document'")
def where_doc_ref(spark, sf_dir):
    return flt.where(docs(spark, sf_dir), doc_ref="related_document").select("id")


@query("where_file_ref", ctes(FILE_REFS_SQL) + "SELECT DISTINCT id FROM file_refs WHERE key = 'content'")
def where_file_ref(spark, sf_dir):
    return flt.where(docs(spark, sf_dir), file_ref="content").select("id")


@query("where_ref_table", ctes(FILE_REFS_SQL) + "SELECT DISTINCT id FROM file_refs WHERE key = 'content'")
def where_ref_table(spark, sf_dir):
    d = docs(spark, sf_dir)
    return flt.with_ref(d, prj.list_refs(d, "file_refs"), "content").select("id")


@query("where_exists", D + "SELECT id FROM docs WHERE quality IS NOT NULL")
def where_exists(spark, sf_dir):
    return flt.where(docs(spark, sf_dir).drop("quality"), exists="quality").select("id")


@query("where_attr_eq", D + """SELECT 'number' AS test, id FROM docs WHERE priority = 0.25
UNION ALL SELECT 'text', id FROM docs WHERE lang = 'en' AND CAST(n_chars AS VARCHAR) = '380'
UNION ALL SELECT 'bool', id FROM docs WHERE lang = 'de' AND priority > 0.5
UNION ALL SELECT 'missing', id FROM docs WHERE quality IS NULL""")
def where_attr_eq(spark, sf_dir):
    d = docs(spark, sf_dir).drop("priority", "quality")
    tests = {"number": {"priority": 0.25}, "text": {"rating": "380"}, "bool": {"rating": True}, "missing": {"quality": None}}
    # ``rating`` True equals the number 1; no text has that many characters.
    parts = [flt.where(d, **f).select(F.lit(t).alias("test"), "id") for t, f in tests.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("where_combined", D + """SELECT id FROM docs
WHERE status = 'inbox' AND doc_id % 3 >= 1 AND doc_id % 4 >= 2 AND lang = 'en' AND quality IS NOT NULL""")
def where_combined(spark, sf_dir):
    return flt.where(
        docs(spark, sf_dir), status="inbox", doc_ref="research_source", file_ref="content", lang="en", exists="quality"
    ).select("id")


# -- property=EXPR --------------------------------------------------------------------------

_SIX = ["==0.5", "!=0.5", ">0.5", "<0.5", ">=0.5", "<=0.5"]


@query("filter_compare_expr", D + ",\n" + """rated AS (
  SELECT id, priority, CASE lang WHEN 'en' THEN CAST(n_chars AS DOUBLE) WHEN 'fr' THEN CAST(n_chars AS DOUBLE)
                       WHEN 'de' THEN CASE WHEN priority > 0.5 THEN 1.0 ELSE 0.0 END END AS rating FROM docs)
""" + "\nUNION ALL ".join(
    [f"SELECT 'priority{e}' AS test, id FROM rated WHERE priority {e.replace('==', '=').replace('!=', '<>')}" for e in _SIX]
    + [f"SELECT 'rating{e}' AS test, id FROM rated WHERE rating {e.replace('==', '=')}" for e in ("> 400", "<= 1", "==1")]
))
def filter_compare_expr(spark, sf_dir):
    d = docs(spark, sf_dir)
    tests = [("priority", e) for e in _SIX] + [("rating", e) for e in ("> 400", "<= 1", "==1")]
    hits = F.array_compact(F.array(*[F.when(flt.match_expression(attribute(d, a), e), F.lit(a + e)) for a, e in tests]))
    return d.select(F.explode(hits).alias("test"), "id")


@query("filter_exists_truthy", D + """SELECT 'quality' AS test, id FROM docs WHERE quality <> 0
UNION ALL SELECT 'toxic', id FROM docs WHERE toxic <> 0
UNION ALL SELECT 'tags', id FROM docs
UNION ALL SELECT 'title', id FROM docs WHERE title <> ''
UNION ALL SELECT 'rating', id FROM docs WHERE lang = 'en' OR (lang = 'fr' AND n_chars <> 0) OR (lang = 'de' AND priority > 0.5)""")
def filter_exists_truthy(spark, sf_dir):
    d = docs(spark, sf_dir).drop("toxic")
    names = ["quality", "toxic", "tags", "title", "rating"]
    hits = F.array_compact(F.array(*[F.when(flt.match_expression(attribute(d, a), "exists"), F.lit(a)) for a in names]))
    return d.select(F.explode(hits).alias("test"), "id")


@query("filter_glob", DT + """SELECT 'src1?' AS test, id FROM docs WHERE regexp_matches(source, '^src1.$')
UNION ALL SELECT 'src[!0-4]*', id FROM docs WHERE regexp_matches(source, '^src[^0-4].*$')
UNION ALL SELECT '*the*', id FROM docs WHERE contains(title, 'the')
UNION ALL SELECT '0.*5', id FROM docs WHERE regexp_matches(CAST(priority AS VARCHAR), '^0\\..*5$')
UNION ALL SELECT '[[]''en''*', id FROM docs WHERE lang = 'en'""")
def filter_glob(spark, sf_dir):
    d = docs(spark, sf_dir)
    tests = [("source", "src1?"), ("source", "src[!0-4]*"), ("title", "*the*"), ("priority", "0.*5"), ("tags", "[[]'en'*")]
    hits = F.array_compact(F.array(*[F.when(flt.match_expression(attribute(d, a), e), F.lit(e)) for a, e in tests]))
    return d.select(F.explode(hits).alias("test"), "id")


@query("doc_list_filter", D + """SELECT id, status FROM docs
WHERE lang = 'en' AND priority > 0.3 AND quality IS NOT NULL AND quality <> 0 AND doc_id % 3 >= 1
  AND regexp_matches(source, '^src1.*$') AND priority > 0.5""")
def doc_list_filter(spark, sf_dir):
    return flt.list_documents(
        docs(spark, sf_dir),
        ['lang="en"', "priority=>0.3", "quality=exists", "doc-ref=research_source", "meta.owner='src1*'", "meta.flags.hot=True"],
    ).select("id", "status")


# -- attribute and list checks --------------------------------------------------------------


def _checks(d, checks: dict[str, AttributeCheck | ListCheck]):
    compiled = [
        F.when((list_check if isinstance(c, ListCheck) else attribute_check)(d, c), F.lit(name)) for name, c in checks.items()
    ]
    return d.select(F.explode(F.array_compact(F.array(*compiled))).alias("test"), "id")


def _union_sql(tests: dict[str, str], source: str = "docs") -> str:
    return "\nUNION ALL ".join(f"SELECT '{name}' AS test, id FROM {source} WHERE {cond}" for name, cond in tests.items())


@query("attr_eq", D + _union_sql({
    "column": "lang = 'fr'", "number": "priority = 0.25", "int_as_bool": "toxic = 1",
    "mixed_number": "(lang = 'fr' AND n_chars = 1) OR (lang = 'de' AND priority > 0.5)", "status": "status = 'done'"}))
def attr_eq(spark, sf_dir):
    return _checks(docs(spark, sf_dir), {
        "column": AttributeCheck("lang", "EQ", "fr"),
        "number": AttributeCheck("priority", "EQ", 0.25),
        "int_as_bool": AttributeCheck("toxic", "EQ", True),
        "mixed_number": AttributeCheck("rating", "EQ", 1),
        "status": AttributeCheck("status", "eq", "done"),
        "absent": AttributeCheck("no_such_attribute", "EQ", "x"),
        "null_value": AttributeCheck("lang", "EQ", None),
    })


@query("attr_ne", D + _union_sql({
    "column": "lang <> 'fr'", "nullable": "quality <> 1", "other_type": "true",
    "mixed": "(lang IN ('en', 'fr') AND NOT (lang = 'fr' AND n_chars = 1)) OR (lang = 'de' AND priority <= 0.5)"}))
def attr_ne(spark, sf_dir):
    return _checks(docs(spark, sf_dir).drop("quality"), {
        "column": AttributeCheck("lang", "NE", "fr"),
        "nullable": AttributeCheck("quality", "NE", 1),
        "other_type": AttributeCheck("lang", "NE", 5),
        "mixed": AttributeCheck("rating", "NE", 1),
        "absent": AttributeCheck("no_such_attribute", "NE", "x"),
    })


@query("attr_range", D + _union_sql({
    "gt": "priority > 0.5", "lt": "priority < 0.1", "gte": "n_chars >= 3000", "lte": "n_chars <= 500",
    "text_gt": "source > 'src5'", "mixed_gt": "(lang = 'fr' AND n_chars > 2000)"}))
def attr_range(spark, sf_dir):
    return _checks(docs(spark, sf_dir), {
        "gt": AttributeCheck("priority", "GT", 0.5),
        "lt": AttributeCheck("priority", "LT", 0.1),
        "gte": AttributeCheck("n_chars", "GTE", 3000),
        "lte": AttributeCheck("n_chars", "LTE", 500),
        "text_gt": AttributeCheck("source", "GT", "src5"),
        "mixed_gt": AttributeCheck("rating", "GT", 2000),
    })


@query("attr_is", D + _union_sql({
    "is_true": "lang = 'de' AND priority > 0.5", "is_not_true": "lang IN ('en', 'fr') OR (lang = 'de' AND priority <= 0.5)",
    "is_not_null": "quality IS NOT NULL", "is_text": "lang = 'es'"}))
def attr_is(spark, sf_dir):
    return _checks(docs(spark, sf_dir).drop("quality"), {
        "is_true": AttributeCheck("rating", "IS", True),
        "is_not_true": AttributeCheck("rating", "IS_NOT", True),
        "is_null": AttributeCheck("quality", "IS", None),
        "is_not_null": AttributeCheck("quality", "IS_NOT", None),
        "is_text": AttributeCheck("lang", "IS", "es"),
    })


@query("attr_glob", D + _union_sql({
    "cp": "regexp_matches(source, '^src1.*$')", "cp_fold": "regexp_matches(lower(title), '^the.*$')",
    "np": "NOT regexp_matches(source, '^src1.*$')", "np_number": "true", "np_null": "quality IS NOT NULL"}))
def attr_glob(spark, sf_dir):
    return _checks(docs(spark, sf_dir).drop("quality"), {
        "cp": AttributeCheck("source", "CP", "src1*"),
        "cp_fold": AttributeCheck("title", "CP", "THE*", case_sensitive=False),
        "np": AttributeCheck("source", "NP", "src1*"),
        "cp_number": AttributeCheck("n_chars", "CP", "3*"),
        "np_number": AttributeCheck("n_chars", "NP", "3*"),
        "np_null": AttributeCheck("quality", "NP", "1"),
    })


@query("attr_regex", D + _union_sql({
    "search": "regexp_matches(title, 'th[ae]n')", "anchor": "regexp_matches(title, '^The')",
    "fold": "regexp_matches(lower(body), 'license')", "not_regex": "NOT regexp_matches(title, '^The')",
    "bad_not_regex": "true", "fold_lowers_pattern": "regexp_matches(lower(source), '\\d')", "not_on_number": "true"}))
def attr_regex(spark, sf_dir):
    return _checks(docs(spark, sf_dir), {
        "search": AttributeCheck("title", "REGEX", "th[ae]n"),
        "anchor": AttributeCheck("title", "REGEX", "^The"),
        "fold": AttributeCheck("body", "REGEX", "LICENSE", case_sensitive=False),
        "not_regex": AttributeCheck("title", "NOT_REGEX", "^The"),
        "bad_regex": AttributeCheck("title", "REGEX", "[unclosed"),
        "bad_not_regex": AttributeCheck("title", "NOT_REGEX", "[unclosed"),
        "fold_lowers_pattern": AttributeCheck("source", "REGEX", r"\D", case_sensitive=False),
        "on_number": AttributeCheck("n_chars", "REGEX", "3"),
        "not_on_number": AttributeCheck("n_chars", "NOT_REGEX", "3"),
    })


@query("attr_case_fold", D + _union_sql({
    "eq": "lang = 'en'", "ne": "lang <> 'en'", "gt": "lower(title) > 'm'", "regex": "regexp_matches(lower(title), '^the ')"}))
def attr_case_fold(spark, sf_dir):
    return _checks(docs(spark, sf_dir), {
        "eq": AttributeCheck("lang", "EQ", "EN", case_sensitive=False),
        "eq_exact": AttributeCheck("lang", "EQ", "EN"),
        "ne": AttributeCheck("lang", "NE", "EN", case_sensitive=False),
        "gt": AttributeCheck("title", "GT", "M", case_sensitive=False),
        "regex": AttributeCheck("title", "REGEX", "^THE ", case_sensitive=False),
    })


@query("list_has", DT + """SELECT DISTINCT 'has' AS test, d.id FROM docs d JOIN doc_tags t USING (doc_id) WHERE tag = 'blog_post_ideas'
UNION ALL SELECT DISTINCT 'contains_fold', d.id FROM docs d JOIN doc_tags t USING (doc_id) WHERE lower(tag) = 'blog_post_ideas'
UNION ALL SELECT DISTINCT 'includes', d.id FROM docs d JOIN doc_tags t USING (doc_id) WHERE tag = 'src3'
UNION ALL SELECT DISTINCT 'variant_fold', d.id FROM docs d JOIN doc_tags t USING (doc_id) WHERE lower(tag) = 'blog_post_ideas'""")
def list_has(spark, sf_dir):
    d = docs(spark, sf_dir)
    in_attrs = _checks(d.drop("tags"), {"variant_fold": ListCheck("tags", "HAS", "BLOG_post_ideas", case_sensitive=False)})
    return _checks(d, {
        "has": ListCheck("tags", "HAS", "blog_post_ideas"),
        "contains_fold": ListCheck("tags", "CONTAINS", "blog_post_ideas", case_sensitive=False),
        "includes": ListCheck("tags", "INCLUDES", "src3"),
        "not_a_list": ListCheck("title", "HAS", "a"),
        "absent": ListCheck("no_such_attribute", "HAS", "a"),
    }).unionByName(in_attrs)


@query("list_not_has", DT + """SELECT 'not_has' AS test, id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM doc_tags t WHERE t.doc_id = d.doc_id AND tag = 'en')
UNION ALL SELECT 'not_contains_fold', id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM doc_tags t WHERE t.doc_id = d.doc_id AND lower(tag) = 'blog_post_ideas')
UNION ALL SELECT 'not_includes', id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM doc_tags t WHERE t.doc_id = d.doc_id AND tag = 'src3')""")
def list_not_has(spark, sf_dir):
    return _checks(docs(spark, sf_dir), {
        "not_has": ListCheck("tags", "NOT_HAS", "en"),
        "not_contains_fold": ListCheck("tags", "NOT_CONTAINS", "Blog_Post_Ideas", case_sensitive=False),
        "not_includes": ListCheck("tags", "NOT_INCLUDES", "src3"),
        "not_a_list": ListCheck("title", "NOT_HAS", "a"),
        "absent": ListCheck("no_such_attribute", "NOT_HAS", "a"),
    })


# -- projections ----------------------------------------------------------------------------


@query("list_columns", D + """SELECT id, status, CASE WHEN length(body) > 100 THEN concat(substr(body, 1, 100), '...') ELSE body END AS body,
  coalesce(CAST(quality AS VARCHAR), '') AS quality, '' AS missing FROM docs""")
def list_columns(spark, sf_dir):
    return prj.listing(docs(spark, sf_dir), ["id", "status", "body", "quality", "missing"])


@query("get_dot_path", D + """SELECT id, source AS owner, lang AS flag_lang, concat(lang, '/', source) AS flat_owner,
  CAST(NULL AS VARCHAR) AS nowhere, coalesce(CAST(quality AS VARCHAR), 'none') AS quality_or_default,
  priority > 0.5 AS hot FROM docs""")
def get_dot_path(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(
        "id",
        prj.get_path("meta.owner").alias("owner"),
        prj.get_path("meta.flags.lang").alias("flag_lang"),
        prj.get_flat("meta.owner").alias("flat_owner"),
        prj.get_path("meta.owner.deeper").alias("nowhere"),
        prj.get(d, "quality", "none").alias("quality_or_default"),
        prj.get_path("meta.flags.hot", "boolean").alias("hot"),
    )


@query("show_attributes", D + """SELECT id, 'lang' AS key, lang AS value FROM docs
UNION ALL SELECT id, 'source', source FROM docs
UNION ALL SELECT id, 'quality', CAST(quality AS VARCHAR) FROM docs
UNION ALL SELECT id, 'toxic', CAST(toxic AS VARCHAR) FROM docs
UNION ALL SELECT id, 'title', title FROM docs
UNION ALL SELECT id, 'meta.owner', concat(lang, '/', source) FROM docs
UNION ALL SELECT id, 'n_tags', CAST(CASE WHEN idea_tag IS NULL THEN 2 ELSE 3 END AS VARCHAR) FROM docs""")
def show_attributes(spark, sf_dir):
    d = docs(spark, sf_dir)
    d = d.withColumn("attrs", F.to_variant_object(F.struct(
        "id", "status", "lang", "source", "quality", "toxic", "title",
        F.concat("lang", F.lit("/"), "source").alias("meta.owner"), F.size("tags").alias("n_tags"))))
    return prj.unpivot_attributes(d).select("id", "key", F.parse_json("value").cast("string").alias("value"))


@query("public_record", D + """SELECT id, status, lang, n_chars,
  CASE doc_id % 3 WHEN 0 THEN '[]'
    WHEN 1 THEN concat('[{"key":"research_source","uuid":"', doc_id // 2, '"}]')
    ELSE concat('[{"key":"research_source","uuid":"', doc_id // 2, '"},{"key":"related_document","uuid":"', doc_id * 2 + 1, '"}]') END AS _doc_refs,
  CASE doc_id % 4 WHEN 0 THEN 0 ELSE doc_id % 4 END AS n_file_refs FROM docs""")
def public_record(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("_persisted", F.lit(True)).withColumn("_original_status", F.col("status"))
    r = prj.public_record(d.select("id", "status", "lang", "n_chars", "doc_refs", "file_refs", "_persisted", "_original_status"))
    n = F.size(F.from_json("_file_refs", "array<struct<key:string>>")).cast("bigint")
    return r.withColumn("n_file_refs", n).drop("_file_refs")


@query("public_stage_record", ctes(STAGES_SQL) + "SELECT stage_id, name, status, CAST(doc_id AS VARCHAR) AS parent_id FROM stages")
def public_stage_record(spark, sf_dir):
    s = stages(spark, sf_dir).select("stage_id", "doc_id", "name", "status")
    held = s.withColumn("parent", F.struct("doc_id", "name")).withColumn("_persisted", F.lit(True)).withColumn("_doc_file", F.lit("stage.md"))
    return prj.public_stage_record(held).drop("doc_id")


@query("locate_stage", ctes(DOCS_SQL, NUMBERED_STAGES_SQL) + """SELECT n.stage_id, concat('/data/', d.status, '/', n.doc_id, '/stages/', n.name, '/', n.counter, '/stage.md') AS path
FROM numbered n JOIN docs d USING (doc_id)""")
def locate_stage(spark, sf_dir):
    held = docs(spark, sf_dir).select("doc_id", F.col("status").alias("doc_status"))
    placed = running_number(stages(spark, sf_dir), ["doc_id", "name"], ["ts", "seq"], [F.date_trunc("hour", "ts")], "counter")
    return placed.join(held, "doc_id").select("stage_id", prj.stage_path("/data").alias("path"))


@query("locate_path", D + "SELECT id, concat('/data/', status, '/', id, '/doc.md') AS path FROM docs")
def locate_path(spark, sf_dir):
    return docs(spark, sf_dir).select("id", prj.document_path("/data").alias("path"))


@query("explode_refs", ctes(DOC_REFS_SQL, FILE_REFS_SQL) + """SELECT 'doc' AS kind, id, pos::BIGINT AS pos, key, CAST(target AS VARCHAR) AS uuid FROM doc_refs
UNION ALL SELECT 'file', id, k::BIGINT + 1, key, uuid FROM file_refs""")
def explode_refs(spark, sf_dir):
    d = docs(spark, sf_dir)
    cols = [F.col(c) for c in ("id", "pos", "key", "uuid")]
    return prj.list_refs(d, "doc_refs").select(F.lit("doc").alias("kind"), *cols).unionByName(
        prj.list_refs(d, "file_refs").select(F.lit("file").alias("kind"), *cols))


@query("ref_keys_column", D + """SELECT id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'research_source' ELSE 'research_source,related_document' END AS "doc-keys"
FROM docs""")
def ref_keys_column(spark, sf_dir):
    return prj.listing(docs(spark, sf_dir), ["id", "doc-keys"])
