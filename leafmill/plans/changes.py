"""Queries: batches of document and stage changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.model import STAGE_STATUS
from leafmill.operators import mutations as mu
from leafmill.plans.evaluation import _MET_SQL, SUMMARY_SQL, numbered
from leafmill.plans.inputs import DEFINITIONS, DOCS_SQL, FILE_REFS_SQL, NUMBERED_STAGES_SQL, STAGES_SQL, ctes, docs, stages, table
from leafmill.plans.registry import query

D = ctes(DOCS_SQL)


def _event_changes(spark, sf_dir):
    """Every event as a change of its user's document; blocks of 1000 ids bucket the order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "event_type", "value", "props")


def _seq_bucket():
    return [F.expr("seq DIV 1000")]


_KEY = "CASE event_type WHEN 'error' THEN 'lang' WHEN 'click' THEN 'click.first' ELSE event_type END"


@query("doc_set", D + f""", last AS (
  SELECT CAST(user_id AS VARCHAR) AS id, {_KEY} AS key, arg_max(event_type || ':' || event_id, event_id) AS v
  FROM events GROUP BY ALL)
SELECT d.id, coalesce(max(v) FILTER (key = 'lang'), any_value(d.lang)) AS lang, max(v) FILTER (key = 'click.first') AS flat_click,
       max(v) FILTER (key = 'signup') AS signup, any_value(d.source) AS source
FROM docs d LEFT JOIN last l ON l.id = d.id GROUP BY d.id""")
def doc_set(spark, sf_dir):
    c = _event_changes(spark, sf_dir)
    c = c.select("id", "seq", F.expr(_KEY).alias("key"), F.concat_ws(":", "event_type", "seq").alias("value"))
    done = mu.set_attributes(docs(spark, sf_dir).select("id", "attrs"), c).accepted
    get = lambda path: F.try_variant_get("attrs", path, "string")
    return done.select(
        "id", get("$.lang").alias("lang"), get("$['click.first']").alias("flat_click"), get("$.signup").alias("signup"),
        get("$.source").alias("source"))


@query("doc_json_set", D + """, changes AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_type FROM events),
last AS (SELECT id, arg_max(k, event_id) AS k FROM changes WHERE event_type <> 'error' GROUP BY id)
SELECT 'value' AS kind, d.id, k, lang FROM docs d JOIN last USING (id)
UNION ALL SELECT 'reject', id, event_id, 'invalid JSON' FROM changes WHERE event_type = 'error'""")
def doc_json_set(spark, sf_dir):
    c = _event_changes(spark, sf_dir)
    broken = F.when(F.col("event_type") == "error", F.regexp_replace("props", r"\}", "")).otherwise(F.col("props"))
    done = mu.set_json_attributes(docs(spark, sf_dir).select("id", "attrs"), c.select("id", "seq", F.lit("data").alias("key"), broken.alias("json")))
    k = F.try_variant_get("attrs", "$.data.k", "bigint")
    values = done.accepted.where(k.isNotNull()).select(
        F.lit("value").alias("kind"), "id", k.alias("k"), F.try_variant_get("attrs", "$.lang", "string").alias("lang"))
    return values.unionByName(done.rejects.select(F.lit("reject").alias("kind"), "id", F.col("seq").alias("k"), F.col("error").alias("lang")))


_PATH = "CASE event_type WHEN 'view' THEN 'tags' WHEN 'click' THEN 'meta.labels' WHEN 'error' THEN 'title' WHEN 'signup' THEN 'meta.owner.x' ELSE 'history' END"


@query("doc_list_add", D + f""", changes AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id, {_PATH} AS path FROM events),
tags AS (
  SELECT id, 1 AS pos, lang AS value FROM docs UNION ALL SELECT id, 2, source FROM docs
  UNION ALL SELECT id, 3, idea_tag FROM docs WHERE idea_tag IS NOT NULL)
SELECT 'item' AS kind, id, path, CASE WHEN path = 'tags' THEN (SELECT CASE WHEN idea_tag IS NULL THEN 2 ELSE 3 END FROM docs d WHERE d.id = c.id) ELSE 0 END
  + row_number() OVER (PARTITION BY id, path ORDER BY event_id) AS pos, CAST(event_id AS VARCHAR) AS value
FROM changes c WHERE path NOT IN ('title', 'meta.owner.x')
UNION ALL SELECT 'item', id, 'tags', pos, value FROM tags WHERE id IN (SELECT id FROM changes WHERE path = 'tags')
UNION ALL SELECT 'reject', id, path, event_id, path || ' is not a list.' FROM changes WHERE path IN ('title', 'meta.owner.x')""")
def doc_list_add(spark, sf_dir):
    c = _event_changes(spark, sf_dir)
    c = c.select("id", "seq", F.expr(_PATH).alias("path"), F.col("seq").cast("string").alias("value"))
    done = mu.append_to_lists(
        docs(spark, sf_dir).select("id", "attrs"), c, _seq_bucket())
    items = done.accepted.select(F.lit("item").alias("kind"), "id", "path", "pos", F.col("value").cast("string").alias("value"))
    return items.unionByName(done.rejects.select(
        F.lit("reject").alias("kind"), "id", "path", F.col("seq").alias("pos"), F.col("error").alias("value")))


@query("add_refs", """WITH edges AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, k::BIGINT AS pos, CASE k WHEN 1 THEN 'research_source' ELSE 'related_document' END AS key,
         CAST(CASE k WHEN 1 THEN doc_id // 2 ELSE doc_id * 2 + 1 END AS VARCHAR) AS uuid
  FROM documents CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k <= doc_id % 3),
added AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, o_custkey % 3 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos,
         o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS uuid
  FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents)),
every AS (SELECT * FROM edges UNION ALL SELECT * FROM added),
data AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(props, event_id) AS json FROM events GROUP BY 1)
SELECT 'ref' AS kind, e.id, e.pos, e.key, e.uuid,
       CASE WHEN e.id IN (SELECT id FROM added) AND e.pos = max(e.pos) OVER (PARTITION BY e.id) THEN d.json END AS data
FROM every e LEFT JOIN data d ON d.id = e.id
UNION ALL SELECT 'reject', CAST(o_custkey AS VARCHAR), o_orderkey, o_orderpriority, CAST(o_orderkey AS VARCHAR), 'Document not found'
FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)""")
def add_refs(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit(" "), "o_orderpriority").alias("key"), F.col("o_orderkey").cast("string").alias("uuid"))
    data = _event_changes(spark, sf_dir).select("id", "seq", F.col("props").alias("json"))
    done = mu.add_refs(docs(spark, sf_dir).select("id", "doc_refs"), "doc_refs", c, _seq_bucket(), data)
    rows = done.accepted.select(F.lit("ref").alias("kind"), "id", "pos", "key", "uuid", "data")
    return rows.unionByName(done.rejects.select(
        F.lit("reject").alias("kind"), "id", F.col("seq").alias("pos"), F.trim("key").alias("key"), "uuid", F.col("error").alias("data")))


def _attrs_sql(before: str = "", labels: str = "", tags: str = "tags") -> str:
    """``attrs`` of ``docs`` as JSON text with sorted keys, with more members before all others and before those of ``meta``."""
    return f"""'{{' || {before or "''"} || '"lang":' || to_json(lang) || ',"meta":{{' || {labels or "''"} || '"flags":{{"hot":' || (priority > 0.5) || ',"lang":' || to_json(lang)
    || '}},"owner":' || to_json(source) || '}},"meta.owner":' || to_json(lang || '/' || source) || ',"priority":' || priority || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null')
    || ',"rating":' || CASE lang WHEN 'en' THEN '"' || n_chars || '"' WHEN 'fr' THEN CAST(n_chars AS VARCHAR) WHEN 'de' THEN CAST(priority > 0.5 AS VARCHAR) ELSE 'null' END
    || ',"source":' || to_json(source) || ',"tags":' || to_json({tags}) || ',"title":' || to_json(title) || ',"toxic":' || coalesce(CAST(toxic AS VARCHAR), 'null') || '}}'"""


_TAGS_SQL = "CASE WHEN idea_tag IS NULL THEN [lang, source] ELSE [lang, source, idea_tag] END"
_WRITE_PATH = _PATH.replace("meta.labels", 'meta."labels" of').replace("'history'", "'a.b.c'")


@query("doc_list_write", D + f""", changes AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id, {_WRITE_PATH} AS path FROM events),
lists AS (SELECT id, path, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS added FROM changes GROUP BY ALL)
SELECT 'document' AS kind, d.id, CAST(NULL AS BIGINT) AS seq, {_attrs_sql(
    """CASE WHEN h.added IS NULL THEN '' ELSE '"a":{"b":{"c":' || to_json(h.added) || '}},' END""",
    """CASE WHEN m.added IS NULL THEN '' ELSE '"\\"labels\\" of":' || to_json(m.added) || ',' END""", f"list_concat({_TAGS_SQL}, coalesce(t.added, []))")} AS value
FROM docs d LEFT JOIN lists h ON h.id = d.id AND h.path = 'a.b.c' LEFT JOIN lists m ON m.id = d.id AND m.path LIKE 'meta.%of'
LEFT JOIN lists t ON t.id = d.id AND t.path = 'tags'
UNION ALL SELECT 'reject', id, event_id, CASE WHEN id NOT IN (SELECT id FROM docs) THEN 'Document not found' ELSE path || ' is not a list.' END
FROM changes WHERE path IN ('title', 'meta.owner.x') OR id NOT IN (SELECT id FROM docs)""")
def doc_list_write(spark, sf_dir):
    """The updated table after list appends: nested paths are made, a quoted key too."""
    c = _event_changes(spark, sf_dir)
    c = c.select("id", "seq", F.expr(_WRITE_PATH).alias("path"), F.col("seq").cast("string").alias("value"))
    done = mu.write_lists(docs(spark, sf_dir).select("id", "attrs"), c)
    return done.accepted.select(F.lit("document").alias("kind"), "id", F.lit(None).cast("bigint").alias("seq"), F.to_json("attrs").alias("value")).unionByName(
        done.rejects.select(F.lit("reject").alias("kind"), "id", "seq", F.col("error").alias("value")))


_DATA = "CASE WHEN event_type = 'error' THEN replace(props, '}', '') ELSE props END"
_DATA_SQL = f"data AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, event_type <> 'error' AS good, {_DATA} AS json FROM events)"


def _written(done, refs, name):
    """The references of the updated table as rows, and what was rejected."""
    r = F.col("r")
    rows = done.accepted.select("id", F.posexplode(refs).alias("pos", "r")).select(
        F.lit("ref").alias("kind"), "id", (F.col("pos") + 1).cast("bigint").alias("pos"), r["key"].alias("key"), r[name].alias("target"), F.to_json(r["data"]).alias("data"))
    return rows.unionByName(done.rejects.select(
        F.lit("reject").alias("kind"), "id", F.col("seq").alias("pos"), "key", F.coalesce(name, "json").alias("target"), F.col("error").alias("data")))


@query("doc_ref_write", D + f""", {_DATA_SQL}, orders_of AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey, o_orderpriority FROM orders),
every AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, k::BIGINT AS pos, CASE k WHEN 1 THEN 'research_source' ELSE 'related_document' END AS key,
         CAST(CASE k WHEN 1 THEN doc_id // 2 ELSE doc_id * 2 + 1 END AS VARCHAR) AS target, 0 AS n
  FROM documents CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k <= doc_id % 3
  UNION ALL SELECT id, doc_id % 3 + row_number() OVER w, o_orderpriority, CAST(o_orderkey AS VARCHAR), count(*) OVER (PARTITION BY id)
  FROM orders_of JOIN docs USING (id) WINDOW w AS (PARTITION BY id ORDER BY o_orderkey)),
last AS (SELECT id, arg_max(json, event_id) AS json FROM data WHERE good GROUP BY id)
SELECT 'ref' AS kind, e.id, pos, key, target, CASE WHEN n > 0 AND pos = max(pos) OVER (PARTITION BY e.id) THEN CAST(json(l.json) AS VARCHAR) END AS data
FROM every e LEFT JOIN last l ON l.id = e.id
UNION ALL SELECT 'reject', id, o_orderkey, o_orderpriority, CAST(o_orderkey AS VARCHAR), 'Document not found' FROM orders_of WHERE id NOT IN (SELECT id FROM docs)
UNION ALL SELECT 'reject', id, event_id, NULL, json, CASE WHEN id IN (SELECT id FROM docs) THEN 'invalid JSON' ELSE 'Document not found' END
FROM data WHERE id NOT IN (SELECT id FROM docs) OR (NOT good AND id IN (SELECT id FROM orders_of))""")
def doc_ref_write(spark, sf_dir):
    """The updated table after document references and their data, part of which is no JSON."""
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit(" "), "o_orderpriority").alias("key"), F.col("o_orderkey").cast("string").alias("uuid"))
    data = _event_changes(spark, sf_dir).select("id", "seq", F.expr(_DATA).alias("json"))
    return _written(mu.write_refs(docs(spark, sf_dir).select("id", "doc_refs"), "doc_refs", c, data), "doc_refs", "uuid")


@query("file_ref_write", ctes(DOCS_SQL, FILE_REFS_SQL) + f""", {_DATA_SQL}, orders_of AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
every AS (
  SELECT id, k::BIGINT + 1 AS pos, key, filename AS target, 0 AS n FROM file_refs
  UNION ALL SELECT id, doc_id % 4 + row_number() OVER w, o_orderpriority, 'o' || o_orderkey || '.txt', count(*) OVER (PARTITION BY id)
  FROM orders_of JOIN docs USING (id) WINDOW w AS (PARTITION BY id ORDER BY o_orderkey)),
last AS (SELECT id, arg_max(json, event_id) AS json FROM data WHERE good GROUP BY id)
SELECT 'ref' AS kind, e.id, pos, key, target, CASE WHEN n > 0 AND pos = max(pos) OVER (PARTITION BY e.id) THEN CAST(json(l.json) AS VARCHAR) END AS data
FROM every e LEFT JOIN last l ON l.id = e.id
UNION ALL SELECT 'reject', id, o_orderkey, o_orderpriority, 'o' || o_orderkey || '.txt', 'Document not found' FROM orders_of WHERE id NOT IN (SELECT id FROM docs)
UNION ALL SELECT 'reject', id, event_id, NULL, json, CASE WHEN id NOT IN (SELECT id FROM docs) THEN 'Document not found'
  WHEN id IN (SELECT id FROM orders_of) THEN 'invalid JSON' ELSE 'file data without an added file' END
FROM data WHERE id NOT IN (SELECT id FROM docs) OR id NOT IN (SELECT id FROM orders_of) OR NOT good""")
def file_ref_write(spark, sf_dir):
    """The updated table after file references and their data; data needs a file of the same batch."""
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("key"),
        F.concat(F.lit("o"), "o_orderkey", F.lit(".txt")).alias("filename"), F.concat(F.lit("u"), "o_orderkey").alias("uuid"))
    data = _event_changes(spark, sf_dir).select("id", "seq", F.expr(_DATA).alias("json"))
    return _written(mu.write_refs(docs(spark, sf_dir).select("id", "file_refs"), "file_refs", c, data), "file_refs", "filename")


@query("doc_create", """WITH p AS (SELECT page_id, url, length(html) AS size, CASE WHEN url LIKE 'https%' THEN 'active' ELSE 'inbox' END AS status, page_id % 3 AS k FROM pages)
SELECT 'document' AS kind, 'page' || page_id AS id, CAST(NULL AS BIGINT) AS seq, status AS part,
  '{"meta":{"hosts":["first",' || to_json(url) || ']},"meta.hosts":"flat",' || CASE WHEN k = 0 THEN '' ELSE '"size":' || size || ',' END || '"title":' || to_json(url) || '}' AS value FROM p
UNION ALL SELECT 'reject', 'page' || page_id, 1, 'json', 'invalid JSON' FROM p WHERE k = 0
UNION ALL SELECT 'reject', 'page' || page_id, 3, 'list', 'title.x is not a list.' FROM p WHERE k = 1
UNION ALL SELECT 'reject', 'page' || page_id, 1, 'file_refs', 'file data without an added file' FROM p WHERE k = 2
UNION ALL SELECT 'file', 'page' || page_id, 1, 'upload_file', '{"k":' || page_id || '}' FROM p WHERE k <> 2""")
def doc_create(spark, sf_dir):
    """New documents from pages: flat values, nested lists, JSON and files with data, some of each wrong."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id").alias("id"), "page_id", "url", F.length("html").alias("size"), (F.col("page_id") % 3).alias("k"))
    new = p.select("id", F.when(F.col("url").startswith("https"), "active").alias("status"), F.lit(None).cast("string").alias("body"))
    row = lambda seq, key, value: F.struct(F.lit(seq).alias("seq"), F.lit(key).alias("key"), value.alias("value"))
    sets = p.select("id", F.inline(F.array(row(1, "title", F.lit("first")), row(2, "title", F.col("url")), row(3, "meta.hosts", F.lit("flat")))))
    lists = p.select("id", F.inline(F.array(row(2, "meta.hosts", F.col("url")), row(1, "meta.hosts", F.lit("first"))))).unionByName(
        p.where("k = 1").select("id", F.lit(3).alias("seq"), F.lit("title.x").alias("key"), F.lit("no").alias("value")))
    jsons = p.select("id", F.lit(1).alias("seq"), F.lit("size").alias("key"), F.when(F.col("k") == 0, "{bad").otherwise(F.col("size").cast("string")).alias("json"))
    files = p.where("k <> 2").select("id", F.lit(1).alias("seq"), F.lit("upload_file").alias("key"), F.lit("page.html").alias("filename"), "url")
    data = p.select("id", F.lit(1).alias("seq"), F.concat(F.lit('{"k": '), "page_id", F.lit("}")).alias("json"))
    stored = docs(spark, sf_dir).where("false").select("id", "status", "body", "attrs", "file_refs")
    done = mu.create(stored, new, sets, jsons, lists, file_refs=files.withColumnRenamed("url", "uuid"), file_data=data)
    number = F.lit(None).cast("bigint").alias("seq")
    rows = done.accepted.select(F.lit("document").alias("kind"), "id", number, F.col("status").alias("part"), F.to_json("attrs").alias("value"))
    held = done.accepted.select("id", F.posexplode("file_refs").alias("pos", "r")).select(
        F.lit("file").alias("kind"), "id", (F.col("pos") + 1).cast("bigint").alias("seq"), F.col("r.key").alias("part"), F.to_json("r.data").alias("value"))
    return rows.unionByName(held).unionByName(done.rejects.select(F.lit("reject").alias("kind"), "id", F.col("seq").cast("bigint").alias("seq"), "part", F.col("error").alias("value")))


@query("doc_body_update", D + """, last AS (
  SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role <> 'user' GROUP BY conv_id)
SELECT id, coalesce(text, body) AS body FROM docs LEFT JOIN last ON conv_id = doc_id""")
def doc_body_update(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("seq"),
        F.when(F.col("role") != "user", F.col("text")).alias("body"))
    return mu.replace_body(docs(spark, sf_dir).select("id", "body"), c)


@query("doc_add", D + """SELECT id, status, lang AS kind, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS BIGINT) AS size FROM docs
UNION ALL SELECT 'page' || page_id, CASE WHEN url LIKE 'https%' THEN 'active' ELSE 'inbox' END, 'json', url, length(html) FROM pages""")
def doc_add(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("id", F.concat(F.lit("page"), "page_id"))
    new = p.select("id", F.when(F.col("url").startswith("https"), F.lit("active")).alias("status"), F.col("html").alias("body"))
    row = lambda seq, key, value, name: F.struct(F.lit(seq).alias("seq"), F.lit(key).alias("key"), value.alias(name))
    sets = p.select("id", F.inline(F.array(row(1, "host", F.lit("first"), "value"), row(2, "host", F.col("url"), "value"), row(3, "lang", F.lit("text"), "value"))))
    jsons = p.select("id", F.inline(F.array(row(1, "lang", F.lit('"json"'), "json"), row(2, "size", F.length("html").cast("string"), "json"))))
    every = mu.create_documents(docs(spark, sf_dir), new, sets, jsons)
    return every.select(
        "id", "status", F.try_variant_get("attrs", "$.lang", "string").alias("kind"),
        F.try_variant_get("attrs", "$.host", "string").alias("host"), F.try_variant_get("attrs", "$.size", "bigint").alias("size"))


@query("new_ids", "SELECT 'inbox' AS status, url AS body, true AS is_uuid, 1 AS holders FROM pages")
def new_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    nothing = docs(spark, sf_dir).where("false")
    made = mu.create_documents(nothing, p.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("status"), F.col("url").alias("body")))
    form = F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    holders = F.count("*").over(Window.partitionBy("id")).cast("int")  # how many documents got the same id
    return made.select("status", "body", form.alias("is_uuid"), holders.alias("holders"))


_NEW_STATUS = "CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'active' WHEN 'error' THEN 'broken' WHEN 'signup' THEN 'archived' ELSE 'blocked' END"


@query("set_status", D + f""", changes AS (SELECT user_id AS doc_id, event_id, {_NEW_STATUS} AS status FROM events),
last AS (SELECT doc_id, arg_max(status, event_id) AS status FROM changes WHERE status <> 'broken' GROUP BY doc_id)
SELECT 'moved' AS kind, d.id, d.status AS old_status, l.status AS new_status FROM docs d JOIN last l USING (doc_id)
UNION ALL SELECT 'reject', CAST(event_id AS VARCHAR), 'broken', 'status must be one of active, archived, blocked, done, inbox' FROM changes WHERE status = 'broken'""")
def set_status(spark, sf_dir):
    c = _event_changes(spark, sf_dir).select("id", "seq", F.expr(_NEW_STATUS).alias("status"))
    done = mu.set_status(docs(spark, sf_dir), c)
    return done.accepted.select(F.lit("moved").alias("kind"), "id", "old_status", "new_status").unionByName(
        done.rejects.select(F.lit("reject").alias("kind"), F.col("seq").cast("string").alias("id"),
                            F.col("status").alias("old_status"), F.col("error").alias("new_status")))


@query("doc_drop", ctes(DOCS_SQL, STAGES_SQL) + """, dropped AS (SELECT doc_id FROM docs WHERE toxic = 1)
SELECT 'document' AS kind, id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM dropped)
UNION ALL SELECT 'stage', stage_id FROM stages WHERE doc_id NOT IN (SELECT doc_id FROM dropped)""")
def doc_drop(spark, sf_dir):
    d = docs(spark, sf_dir)
    dropped = d.where("toxic = 1").select("id", "doc_id")
    left = mu.drop_documents(d, dropped)
    stages_left = stages(spark, sf_dir).join(dropped.select("doc_id"), "doc_id", "left_anti")
    return left.select(F.lit("document").alias("kind"), "id").unionByName(
        stages_left.select(F.lit("stage").alias("kind"), F.col("stage_id").alias("id")))


@query("drop_all", D + """SELECT 'done' AS status, count_if(status = 'done')::BIGINT AS dropped, count_if(status <> 'done')::BIGINT AS remaining FROM docs
UNION ALL SELECT 'all', count(*), 0 FROM docs""")
def drop_all(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = []
    for status in ("done", "all"):
        left, gone = mu.drop_all(d, status)
        both = gone.select(F.lit(1).alias("gone")).unionByName(left.select(F.lit(0).alias("gone")))
        parts.append(both.agg(F.count_if(F.col("gone") == 1).alias("dropped"), F.count_if(F.col("gone") == 0).alias("remaining")).select(
            F.lit(status).alias("status"), "dropped", "remaining"))
    return parts[0].unionByName(parts[1])


@query("validate_status", ctes(DOCS_SQL, STAGES_SQL) + """SELECT 'document' AS kind, id, lang AS status, 'Invalid status: ' || lang AS error FROM docs
UNION ALL SELECT 'stage', stage_id, name, 'Invalid status: ' || name FROM stages WHERE name <> 'active'
UNION ALL SELECT 'parent', stage_id, status, 'stage parent must be a document' FROM stages WHERE doc_id NOT IN (SELECT doc_id FROM docs)""")
def validate_status(spark, sf_dir):
    d, s = docs(spark, sf_dir), stages(spark, sf_dir)
    bad_docs = mu.validate_status(d.select("id", F.col("lang").alias("status"))).rejects.select(F.lit("document").alias("kind"), "id", "status", "error")
    bad_stages = mu.validate_status(s.select(F.col("stage_id").alias("id"), F.col("name").alias("status")), STAGE_STATUS).rejects
    lost = mu.validate_parents(s, d).rejects.select(F.lit("parent").alias("kind"), F.col("stage_id").alias("id"), "status", "error")
    return bad_docs.unionByName(bad_stages.select(F.lit("stage").alias("kind"), "id", "status", "error")).unionByName(lost)


# -- stages ---------------------------------------------------------------------------------

_STAGE_NAME = "CASE o_orderstatus WHEN 'F' THEN 'signup' WHEN 'O' THEN 'purchase' ELSE CASE WHEN o_totalprice > 250000 THEN 'review' ELSE 'unknown' END END"
_FLOW = "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'nosuch' WHEN o_orderstatus = 'O' THEN 'ship' END"


@query("add_stage", ctes(DOCS_SQL, STAGES_SQL, SUMMARY_SQL) + f""", requests AS (
  SELECT o_custkey AS doc_id, o_orderkey AS seq, {_STAGE_NAME} AS name, {_FLOW} AS workflow FROM orders),
checked AS (SELECT *, CASE WHEN doc_id NOT IN (SELECT doc_id FROM docs) THEN 'Document not found'
  WHEN name = 'unknown' THEN 'Stage definition ''unknown'' not found'
  WHEN workflow = 'nosuch' THEN 'Workflow ''nosuch'' not found in stage ''signup''' END AS error FROM requests),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY seq) AS k FROM checked WHERE error IS NULL)
SELECT 'added' AS kind, s.doc_id, s.name, k + CASE s.name WHEN 'signup' THEN n_signup WHEN 'purchase' THEN n_purchase ELSE 0 END AS n,
  CASE WHEN CASE s.name WHEN 'review' THEN j.met_review ELSE {_MET_SQL} END THEN 'active' ELSE 'scheduled' END AS status
FROM good s JOIN joined j USING (doc_id)
UNION ALL SELECT 'reject', doc_id, name, seq, error FROM checked WHERE error IS NOT NULL""")
def add_stage(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.expr(_STAGE_NAME).alias("name"), F.expr(_FLOW).alias("workflow"))
    done = mu.add_stages(docs(spark, sf_dir), stages(spark, sf_dir), r, DEFINITIONS, _seq_bucket())
    return done.accepted.select(F.lit("added").alias("kind"), "doc_id", "name", F.col("counter").alias("n"), "status").unionByName(
        done.rejects.select(F.lit("reject").alias("kind"), "doc_id", "name", F.col("seq").alias("n"), F.col("error").alias("status")))


_SET_TO = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'blocked' ELSE 'finished' END"


@query("update_stage_status", ctes(DOCS_SQL, NUMBERED_STAGES_SQL) + f""", changes AS (
  SELECT o_custkey AS doc_id, 'signup' AS name, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 4 AS counter, o_orderkey AS seq, {_SET_TO} AS status FROM orders),
known AS (SELECT * FROM changes WHERE doc_id IN (SELECT doc_id FROM docs)),
last AS (SELECT doc_id, name, counter, max(seq) AS seq, arg_max(status, seq) AS status FROM known WHERE status <> 'finished' GROUP BY ALL),
joined AS (SELECT l.*, n.status AS old_status FROM last l LEFT JOIN numbered n USING (doc_id, name, counter))
SELECT 'updated' AS kind, doc_id, counter, old_status, status AS new_status FROM joined WHERE old_status IS NOT NULL
UNION ALL SELECT 'reject', doc_id, seq, status, 'Document not found' FROM changes WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT 'reject', doc_id, seq, status, 'Invalid stage status: finished' FROM known WHERE status = 'finished'
UNION ALL SELECT 'reject', doc_id, seq, status, 'Stage signup (counter ' || counter || ') not found' FROM joined WHERE old_status IS NULL""")
def update_stage_status(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit("signup").alias("name"), (F.expr("CAST(substr(o_orderpriority, 1, 1) AS BIGINT)") * 4).alias("counter"),
        F.col("o_orderkey").alias("seq"), F.expr(_SET_TO).alias("status"))
    done = mu.update_stage_status(docs(spark, sf_dir), numbered(spark, sf_dir), c)
    return done.accepted.select(F.lit("updated").alias("kind"), "doc_id", "counter", "old_status", "new_status").unionByName(
        done.rejects.select(F.lit("reject").alias("kind"), "doc_id", F.col("seq").alias("counter"), F.col("status").alias("old_status"), F.col("error").alias("new_status")))


_RESULT = """CASE o_orderstatus WHEN 'F' THEN to_json(named_struct('doc', named_struct('title', o_orderpriority, 'body', concat('order ', o_orderkey), 'content', 'x')))
  WHEN 'O' THEN to_json(named_struct('doc', concat('text ', o_orderkey))) ELSE to_json(named_struct('other', o_orderkey)) END"""


def _results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("true")
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.lit("signup").alias("name"), (F.expr("CAST(substr(o_orderpriority, 1, 1) AS BIGINT)") * 4).alias("counter"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("workflow"),
        F.try_variant_get(F.parse_json(F.expr(_RESULT)), "$.doc", "variant").alias("doc"))


@query("persist_results", ctes(DOCS_SQL, NUMBERED_STAGES_SQL) + """, results AS (
  SELECT o_custkey AS doc_id, 'signup' AS name, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 4 AS counter, o_orderkey AS seq, o_orderpriority AS workflow,
    CASE o_orderstatus WHEN 'F' THEN '{"title":"' || o_orderpriority || '"}' ELSE '{}' END AS header,
    CASE o_orderstatus WHEN 'F' THEN 'order ' ELSE 'text ' END || o_orderkey AS body
  FROM orders WHERE o_orderstatus <> 'P'),
known AS (SELECT * FROM results WHERE doc_id IN (SELECT doc_id FROM docs)),
last AS (SELECT doc_id, name, counter, workflow, max(seq) AS seq, arg_max(header, seq) AS header, arg_max(body, seq) AS body FROM known GROUP BY ALL),
joined AS (SELECT l.*, n.stage_id FROM last l LEFT JOIN numbered n USING (doc_id, name, counter))
SELECT 'stored' AS kind, doc_id, counter, header, body FROM joined WHERE stage_id IS NOT NULL
UNION ALL SELECT 'reject', doc_id, seq, workflow, 'Document not found' FROM results WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT 'reject', doc_id, seq, workflow, 'Stage signup with counter ' || counter || ' not found' FROM joined WHERE stage_id IS NULL""")
def persist_results(spark, sf_dir):
    done = mu.persist_results(docs(spark, sf_dir), numbered(spark, sf_dir), _results(spark, sf_dir))
    return done.accepted.select(F.lit("stored").alias("kind"), "doc_id", "counter", "header", "body").unionByName(
        done.rejects.select(F.lit("reject").alias("kind"), "doc_id", F.col("seq").alias("counter"), F.col("workflow").alias("header"), F.col("error").alias("body")))


@query("normalise_result", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'order ' ELSE 'text ' END || o_orderkey AS body,
  CASE o_orderstatus WHEN 'F' THEN '{"title":"' || o_orderpriority || '"}' ELSE '{}' END AS header FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey + 1000000000, CASE WHEN o_totalprice > 250000 THEN 'True' ELSE CAST(o_orderkey AS VARCHAR) END, '{}' FROM orders""")
def normalise_result(spark, sf_dir):
    body, header = mu.normalise_result()
    texts = _results(spark, sf_dir).where("doc IS NOT NULL").select(F.col("seq").alias("o_orderkey"), body.alias("body"), header.alias("header"))
    scalars = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1000000000).alias("o_orderkey"),
        F.when(F.col("o_totalprice") > 250000, F.lit(True).cast("variant")).otherwise(F.col("o_orderkey").cast("variant")).alias("doc"))
    return texts.unionByName(scalars.select("o_orderkey", body.alias("body"), header.alias("header")))


@query("changed_documents", D + "SELECT id, lang FROM docs WHERE doc_id % 4 = 1")
def changed_documents(spark, sf_dir):
    old = docs(spark, sf_dir).select("id", "lang", "attrs", "tags", "body")
    values = old.where("CAST(id AS BIGINT) % 4 = 1").select("id", F.lit(1).alias("seq"), F.lit("lang").alias("key"), F.concat("lang", F.lit("?")).alias("value"))
    return mu.changed_rows(old, mu.set_attributes(old, values).accepted, ["id"]).select("id", "lang")


@query("changed_rows", ctes(STAGES_SQL) + "SELECT stage_id, 'cancelled' AS status FROM stages WHERE status = 'scheduled'")
def changed_rows(spark, sf_dir):
    old = stages(spark, sf_dir).select("stage_id", "doc_id", "name", "status")
    new = old.withColumn("status", F.when(F.col("status") == "scheduled", F.lit("cancelled")).otherwise(F.col("status")))
    return mu.changed_rows(old, new, ["stage_id"]).select("stage_id", "status")
