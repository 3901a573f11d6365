"""Queries: layered catalogs, sync diffs, requirements and extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import catalog as cat
from leafmill.operators.ranking import last_per_key, top_k
from leafmill.plans.inputs import (
    FILE_ORDER,
    LAYERS_SQL,
    LOCAL_SQL,
    REMOTE_SQL,
    RUNS_SQL,
    ctes,
    layers,
    local_workflows,
    remote_workflows,
    runs,
    table,
)
from leafmill.plans.registry import query

L = ctes(LAYERS_SQL)
LR = ctes(LOCAL_SQL, REMOTE_SQL)

# -- layers ---------------------------------------------------------------------------------


@query("layer_rank", """SELECT s_name AS name, s_nationkey AS priority, row_number() OVER (ORDER BY s_nationkey, s_name) AS layer_rank
FROM supplier WHERE s_acctbal > 1000""")
def layer_rank(spark, sf_dir):
    vendors = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("priority"), (F.col("s_acctbal") > 1000).alias("enabled"))
    # 'Supplier#000000123': the first 14 characters part the names of one priority into blocks of 10,000.
    return cat.rank_layers(vendors, [F.col("priority"), F.left("name", F.lit(14))])


@query("layer_overlay", L + """SELECT name, layer, quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY name ORDER BY layer_rank DESC, file_no DESC, part DESC, supplier DESC, price DESC) AS rn FROM layers) WHERE rn = 1""")
def layer_overlay(spark, sf_dir):
    return cat.overlay(layers(spark, sf_dir), FILE_ORDER).select("name", "layer", "quantity")


ORIGIN_SQL = """origin AS (SELECT name, CASE WHEN bool_or(layer = 'project') AND bool_or(layer <> 'project') THEN 'extended'
  WHEN bool_or(layer LIKE 'vendor%') THEN 'vendor' WHEN bool_or(layer = 'lib') THEN 'standard' ELSE 'custom' END AS origin
  FROM layers GROUP BY name)"""


@query("classify_origin", ctes(LAYERS_SQL, ORIGIN_SQL) + "SELECT name, origin FROM origin")
def classify_origin(spark, sf_dir):
    return cat.classify_origin(layers(spark, sf_dir))


@query("catalog_status", ctes(LAYERS_SQL, ORIGIN_SQL) + """SELECT name, origin, CASE WHEN name IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') THEN 'active' ELSE 'unused' END AS status FROM origin""")
def catalog_status(spark, sf_dir):
    required = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("name"))
    return cat.catalog_status(layers(spark, sf_dir), required)


@query("names_by_layer", L + """SELECT 'name' AS kind, layer, name, 0::BIGINT AS n FROM layers GROUP BY ALL
UNION ALL SELECT 'files', layer, name, count(*) FROM layers l
WHERE layer_rank = (SELECT max(layer_rank) FROM layers m WHERE m.name = l.name) GROUP BY ALL""")
def names_by_layer(spark, sf_dir):
    files = layers(spark, sf_dir)
    names = cat.names_by_layer(files).select(F.lit("name").alias("kind"), "layer", "name", F.lit(0).cast("bigint").alias("n"))
    flat = cat.effective_files(files, FILE_ORDER).groupBy("layer", "name").agg(F.count("*").alias("n"))
    return names.unionByName(flat.select(F.lit("files").alias("kind"), "layer", "name", "n"))


@query("overview_extended", L + """, el AS (SELECT DISTINCT CASE WHEN quantity > 25 THEN 'stages' ELSE 'tasks' END AS section, name, layer FROM layers)
SELECT DISTINCT section, name, EXISTS (SELECT 1 FROM el p WHERE p.layer = 'project' AND p.section = e.section AND p.name = e.name) AS is_extended
FROM el e WHERE layer <> 'project'""")
def overview_extended(spark, sf_dir):
    files = layers(spark, sf_dir).withColumn("section", F.when(F.col("quantity") > 25, "stages").otherwise("tasks"))
    return cat.overview_extended(files.where("layer <> 'project'"), files.where("layer = 'project'"))


def _definition_files(spark, sf_dir):
    """Each catalog file as a definition: vendor_o files with a discount put text in place of an object."""
    files = layers(spark, sf_dir)
    base = F.to_variant_object(F.struct(
        F.col("quantity").cast("bigint").alias("quantity"),
        F.struct("part", F.struct(F.col("discount").cast("string").alias("discount")).alias("limits")).alias("requirements")))
    priced = F.to_variant_object(F.struct(
        F.col("quantity").cast("bigint").alias("quantity"),
        F.struct(F.struct(F.col("supplier").alias("supplier")).alias("limits")).alias("requirements")))
    plain = F.to_variant_object(F.struct(F.lit("none").alias("requirements")))
    payload = F.when((F.col("layer") == "vendor_o") & (F.col("discount") > 0.05), plain).when(F.col("quantity") > 25, base).otherwise(priced)
    return files.withColumn("payload", payload)


@query("deep_merge_layers", L + """, files AS (
  SELECT *, CASE WHEN layer = 'vendor_o' AND discount > 0.05 THEN 'plain' WHEN quantity > 25 THEN 'base' ELSE 'priced' END AS form,
         row_number() OVER (PARTITION BY name ORDER BY layer_rank, file_no, part, supplier, price) AS rn FROM layers),
cuts AS (SELECT name, max(rn) FILTER (form = 'plain') AS cut, max(rn) AS top, max(rn) FILTER (form <> 'plain') AS obj FROM files GROUP BY name),
live AS (SELECT f.*, coalesce(c.cut, 0) AS cut, c.obj FROM files f JOIN cuts c USING (name))
SELECT name, 'quantity' AS path, CAST(arg_max(quantity, rn)::BIGINT AS VARCHAR) AS value FROM live WHERE form <> 'plain' GROUP BY name
UNION ALL SELECT name, 'requirements', '"none"' FROM cuts WHERE cut > coalesce(obj, 0)
UNION ALL SELECT name, 'requirements.part', CAST(arg_max(part, rn) AS VARCHAR) FROM live WHERE form = 'base' AND rn > cut GROUP BY name
UNION ALL SELECT name, 'requirements.limits.discount', '"' || CAST(arg_max(discount, rn) AS VARCHAR) || '"' FROM live WHERE form = 'base' AND rn > cut GROUP BY name
UNION ALL SELECT name, 'requirements.limits.supplier', CAST(arg_max(supplier, rn) AS VARCHAR) FROM live WHERE form = 'priced' AND rn > cut GROUP BY name""")
def deep_merge_layers(spark, sf_dir):
    merged = cat.deep_merge(_definition_files(spark, sf_dir), ["name"], FILE_ORDER)
    return merged.leaves().withColumn("path", F.array_join("path", "."))


def _flow_files(spark, sf_dir):
    """The definitions with a list of workflows: one with a name, and with a low discount a text without one."""
    files = _definition_files(spark, sf_dir)
    flow = F.to_variant_object(F.map_from_arrays(
        F.array(F.lit("name"), F.concat(F.lit("p"), F.col("file_no") % 2)),
        F.array(F.concat(F.lit("wf"), F.col("part") % 3).cast("variant"), F.col("part").cast("variant"))))
    flows = F.when(F.col("discount") < 0.03, F.array(flow, F.concat(F.lit("x"), "part").cast("variant"))).otherwise(F.array(flow))
    with_flows = F.to_variant_object(F.map_concat(
        F.try_variant_get("payload", "$", "map<string,variant>"), F.create_map(F.lit("workflows"), flows.cast("variant"))))
    plain = F.try_variant_get("payload", "$.quantity", "bigint").isNull()
    return files.withColumn("payload", F.when(plain, F.col("payload")).otherwise(with_flows))


@query("merged_definitions", L + """, files AS (
  SELECT *, CASE WHEN layer = 'vendor_o' AND discount > 0.05 THEN 'plain' WHEN quantity > 25 THEN 'base' ELSE 'priced' END AS form,
         row_number() OVER (PARTITION BY name ORDER BY layer_rank, file_no, part, supplier, price) AS rn FROM layers),
cuts AS (SELECT name, max(rn) FILTER (form = 'plain') AS cut, max(rn) FILTER (form <> 'plain') AS obj FROM files GROUP BY name),
live AS (SELECT f.*, coalesce(c.cut, 0) AS cut, c.obj FROM files f JOIN cuts c USING (name) WHERE form <> 'plain'),
req AS (SELECT name, arg_max(quantity, rn)::BIGINT AS quantity, arg_max(part, rn) FILTER (form = 'base' AND rn > cut) AS part,
  arg_max(discount, rn) FILTER (form = 'base' AND rn > cut) AS discount, arg_max(supplier, rn) FILTER (form = 'priced' AND rn > cut) AS supplier, any_value(obj) AS obj FROM live GROUP BY name),
flows AS (SELECT name, part % 3 AS k, max(rn) AS rn, arg_max(part, rn) FILTER (file_no % 2 = 0) AS p0, arg_max(part, rn) FILTER (file_no % 2 = 1) AS p1, any_value(obj) AS last FROM live GROUP BY ALL),
items AS (
  SELECT name, rn, 0 AS pos, rn = last AS is_last, true AS named, '{"name":"wf' || k || '"' || coalesce(',"p0":' || p0, '') || coalesce(',"p1":' || p1, '') || '}' AS item FROM flows
  UNION ALL SELECT name, rn, 1, rn = obj, false, '"x' || part || '"' FROM live WHERE discount < 0.03),
lists AS (SELECT name, string_agg(item, ',' ORDER BY CASE WHEN is_last THEN 1 WHEN named THEN 2 ELSE 0 END, CASE WHEN is_last THEN 0 WHEN named THEN -rn ELSE rn END, pos) AS flows FROM items GROUP BY name)
SELECT c.name, CASE WHEN c.obj IS NULL THEN '{"requirements":"none"}' ELSE '{"quantity":' || r.quantity || ',"requirements":' ||
  CASE WHEN coalesce(c.cut, 0) > c.obj THEN '"none"' ELSE '{"limits":{' || concat_ws(',', '"discount":"' || r.discount || '"', '"supplier":' || r.supplier) || '}' || coalesce(',"part":' || r.part, '') || '}' END
  || ',"workflows":[' || l.flows || ']}' END AS definition
FROM cuts c LEFT JOIN req r ON r.name = c.name LEFT JOIN lists l ON l.name = c.name""")
def merged_definitions(spark, sf_dir):
    """One whole definition per name, lists of workflows merged by their names."""
    merged = cat.deep_merge(_flow_files(spark, sf_dir), ["name"], FILE_ORDER)
    return merged.definitions().withColumn("definition", F.to_json("definition"))


ITEMS_SQL = """raw AS (SELECT name AS owner, layer_rank AS layer, file_no, max(part) AS part, arg_max(discount, part * 100 + discount) AS discount FROM layers GROUP BY ALL),
items AS (SELECT owner, layer, CASE WHEN discount < 0.02 THEN NULL ELSE 'wf' || file_no END AS item, part * 10 + file_no AS item_no FROM raw)"""


@query("merge_named_lists", ctes(LAYERS_SQL, ITEMS_SQL) + """, last AS (SELECT owner, max(layer) AS last FROM items GROUP BY owner),
survivors AS (
  SELECT owner, item, max(layer) AS layer, arg_max(item_no, layer) AS item_no FROM items WHERE item IS NOT NULL GROUP BY owner, item
  UNION ALL SELECT owner, item, layer, item_no FROM items WHERE item IS NULL)
SELECT s.owner, s.item, s.layer, s.item_no, row_number() OVER (PARTITION BY s.owner ORDER BY
  CASE WHEN s.layer = l.last THEN 1 WHEN item IS NULL THEN 0 ELSE 2 END,
  CASE WHEN s.layer = l.last THEN 0 WHEN item IS NULL THEN s.layer ELSE -s.layer END, s.item_no) AS pos
FROM survivors s JOIN last l USING (owner)""")
def merge_named_lists(spark, sf_dir):
    # The lines of one order in one layer are the list of one file; the part and line numbers give the place in it.
    files = layers(spark, sf_dir).select(F.col("name").alias("owner"), F.col("layer_rank").alias("layer"), "file_no", "part", "discount")
    one = last_per_key(files, ["owner", "layer", "file_no"], [F.col("part"), F.col("discount")])
    item = F.when(F.col("discount") >= 0.02, F.concat(F.lit("wf"), "file_no"))
    items = one.select("owner", "layer", item.alias("item"), (F.col("part") * 10 + F.col("file_no")).alias("item_no"))
    return cat.merged_list_order(items, "owner", "layer", [F.expr("item_no DIV 10000")])


# -- local against remote -------------------------------------------------------------------


@query("sync_status", LR + """SELECT coalesce(l.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'only_local' WHEN l.name IS NULL THEN 'only_remote' ELSE 'common' END AS state
FROM (SELECT DISTINCT name FROM local_wf) l FULL JOIN (SELECT DISTINCT name FROM remote_wf) r ON l.name = r.name""")
def sync_status(spark, sf_dir):
    return cat.sync_status(local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir))


@query("sync_counts", LR + """, l AS (SELECT DISTINCT name FROM local_wf), r AS (SELECT DISTINCT name FROM remote_wf)
SELECT (SELECT count(*) FROM l) AS local, (SELECT count(*) FROM r) AS remote, (SELECT count(*) FROM l JOIN r USING (name)) AS common,
  (SELECT count(*) FROM l WHERE name NOT IN (SELECT name FROM r)) AS only_local, (SELECT count(*) FROM r WHERE name NOT IN (SELECT name FROM l)) AS only_remote""")
def sync_counts(spark, sf_dir):
    return cat.sync_counts(local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir))


@query("missing_versions", LR + "SELECT name, version FROM local_wf EXCEPT SELECT name, version FROM remote_wf")
def missing_versions(spark, sf_dir):
    return cat.missing_versions(local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir))


@query("upload_plan_summary", ctes(LOCAL_SQL, REMOTE_SQL) + """, plan AS (SELECT CASE WHEN l.name = 0 THEN 'failed'
  WHEN (l.name, l.version) IN (SELECT (name, version) FROM remote_wf) THEN 'skipped' ELSE 'uploaded' END AS state FROM local_wf l)
SELECT count(*) FILTER (state = 'uploaded') AS uploaded, count(*) FILTER (state = 'skipped') AS skipped,
  count(*) FILTER (state = 'failed') AS failed, count(*) AS total FROM plan""")
def upload_plan_summary(spark, sf_dir):
    # The files of entry 0 lack a name.
    local = local_workflows(spark, sf_dir).withColumn("name", F.nullif("name", F.lit(0)))
    return cat.upload_summary(cat.upload_plan(local, remote_workflows(spark, sf_dir)))


@query("versions_per_name", ctes(REMOTE_SQL) + "SELECT name, string_agg('v' || version, ', ' ORDER BY version) AS versions FROM remote_wf GROUP BY name")
def versions_per_name(spark, sf_dir):
    return cat.versions_per_name(remote_workflows(spark, sf_dir))


@query("active_runs", """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS name, CAST(substr(o_orderpriority, 1, 1) AS INT) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PENDING' ELSE CASE WHEN o_totalprice > 250000 THEN 'RUNNING' ELSE 'FAILED' END END AS status FROM orders),
active AS (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY run_id) AS rn FROM runs WHERE status IN ('RUNNING', 'PENDING'))
SELECT name, version, count(*) AS n, string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY run_id) FILTER (rn <= 3) AS samples FROM active GROUP BY name, version""")
def active_runs(spark, sf_dir):
    return cat.active_runs(runs(spark, sf_dir).withColumn("name", F.col("customer")))


@query("prune_plan", ctes(LOCAL_SQL, REMOTE_SQL, RUNS_SQL) + """, active AS (SELECT name, version, count(*) AS n FROM runs WHERE status IN ('RUNNING', 'PENDING') GROUP BY ALL)
SELECT r.name, r.version, coalesce(n, 0) AS active_runs, CASE WHEN coalesce(n, 0) = 0 THEN 'delete' ELSE 'skip' END AS action
FROM remote_wf r LEFT JOIN active a USING (name, version) WHERE r.name NOT IN (SELECT name FROM local_wf)""")
def prune_plan(spark, sf_dir):
    return cat.prune_plan(local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir), runs(spark, sf_dir))


@query("orphan_tasks", """SELECT DISTINCT l_partkey AS name, l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1 AND l_returnflag = 'A') AS in_use
FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0.08 AND l_returnflag = 'N')""")
def orphan_tasks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("name", F.col("l_partkey"))
    return cat.orphan_tasks(li.where("l_tax = 0.08 AND l_returnflag = 'N'"), li, li.where("l_discount = 0.1 AND l_returnflag = 'A'"))


@query("sorted_catalog", ctes(REMOTE_SQL) + "SELECT name, version FROM remote_wf ORDER BY name, version")
def sorted_catalog(spark, sf_dir):
    return remote_workflows(spark, sf_dir).orderBy("name", "version")


@query("top_k_per_key", """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_k_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# -- names ----------------------------------------------------------------------------------


@query("names_union", L + "SELECT DISTINCT name FROM layers")
def names_union(spark, sf_dir):
    files = layers(spark, sf_dir)
    return cat.names_union(*[files.where(F.col("layer") == layer) for layer in ("lib", "vendor_f", "vendor_o", "project")])


@query("names_diff", LR + """SELECT 'only_local' AS side, name FROM (SELECT name FROM local_wf EXCEPT SELECT name FROM remote_wf)
UNION ALL SELECT 'only_remote', name FROM (SELECT name FROM remote_wf EXCEPT SELECT name FROM local_wf)""")
def names_diff(spark, sf_dir):
    a, b = local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir)
    return cat.names_difference(a, b).select(F.lit("only_local").alias("side"), "name").unionByName(
        cat.names_difference(b, a).select(F.lit("only_remote").alias("side"), "name"))


@query("names_intersect", LR + "SELECT name FROM local_wf INTERSECT SELECT name FROM remote_wf")
def names_intersect(spark, sf_dir):
    return cat.names_intersection(local_workflows(spark, sf_dir), remote_workflows(spark, sf_dir))


@query("ordered_distinct", """WITH words AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
firsts AS (SELECT conv_id, turn, w, min(i) AS i FROM words GROUP BY ALL)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM firsts GROUP BY conv_id, turn""")
def ordered_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


# -- requirements and extras ----------------------------------------------------------------

EXTRAS_SQL = """reqs AS (SELECT c_custkey AS extra, 'nation ' || c_nationkey AS package FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0),
installed AS (SELECT 'nation ' || n_nationkey AS package FROM nation WHERE n_regionkey <> 0
  UNION ALL SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'),
extras AS (SELECT c_custkey AS extra, (SELECT count(*) FROM reqs r WHERE r.extra = c_custkey) AS n_packages,
  NOT EXISTS (SELECT 1 FROM reqs r WHERE r.extra = c_custkey AND package NOT IN (SELECT package FROM installed)) AS listed FROM customer)"""


def _extras(spark, sf_dir):
    """Customers as extras: their nation and segment are the packages; in debt they have none."""
    c = table(spark, sf_dir, "customer")
    solvent = c.where("c_acctbal >= 0")
    reqs = solvent.select(F.col("c_custkey").alias("extra"), F.explode(F.array(
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.col("c_mktsegment"))).alias("package"))
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("package"))
    installed = nations.union(c.where("c_mktsegment <> 'MACHINERY'").select("c_mktsegment").distinct())
    return cat.satisfied_extras(reqs, installed, c.select(F.col("c_custkey").alias("extra")))


@query("satisfied_extras", ctes(EXTRAS_SQL) + "SELECT extra, n_packages, listed, listed AND n_packages > 0 AS usable FROM extras")
def satisfied_extras(spark, sf_dir):
    return _extras(spark, sf_dir)


@query("extras_report", ctes(EXTRAS_SQL) + "SELECT count(*) AS available, count(*) FILTER (listed) AS installed, bool_and(listed) AS all_installed FROM extras")
def extras_report(spark, sf_dir):
    return cat.extras_report(_extras(spark, sf_dir))


STAGE_EXTRAS_SQL = """stage_extras AS (SELECT o_orderkey AS stage, o_custkey AS extra FROM orders
  UNION ALL SELECT o_orderkey, o_custkey // 2 FROM orders WHERE o_totalprice > 250000)"""


def _stage_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    definitions = o.select(F.col("o_orderkey").alias("name"), (F.col("o_orderstatus") != "F").alias("active"))
    stage_extras = o.select(F.col("o_orderkey").alias("stage"), F.col("o_custkey").alias("extra")).unionByName(
        o.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("stage"), F.expr("o_custkey DIV 2").alias("extra")))
    return definitions, stage_extras


@query("extras_to_stages", ctes(STAGE_EXTRAS_SQL) + """SELECT DISTINCT extra, stage FROM stage_extras
WHERE stage IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def extras_to_stages(spark, sf_dir):
    return cat.extras_to_stages(*_stage_tables(spark, sf_dir))


@query("extras_missing_extraneous", ctes(EXTRAS_SQL, STAGE_EXTRAS_SQL) + """, need AS (SELECT DISTINCT extra FROM stage_extras WHERE stage IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT 'missing' AS kind, extra FROM need WHERE extra NOT IN (SELECT extra FROM extras WHERE listed)
UNION ALL SELECT 'extraneous', extra FROM extras WHERE listed AND extra NOT IN (SELECT extra FROM need)""")
def extras_missing_extraneous(spark, sf_dir):
    _, stage_extras = _stage_tables(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("stage"))
    return cat.missing_and_extraneous(stage_extras.join(urgent, "stage", "left_semi"), _extras(spark, sf_dir).where("listed"))


REQUIRED_SQL = """required AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS name FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    AND l_orderkey NOT IN (SELECT stage FROM stage_extras WHERE extra NOT IN (SELECT extra FROM extras WHERE listed AND n_packages > 0)))"""


def _required(spark, sf_dir):
    definitions, stage_extras = _stage_tables(spark, sf_dir)
    flows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("workflow"))
    return cat.required_workflows(definitions, stage_extras, _extras(spark, sf_dir).where("usable"), flows)


@query("required_workflows", ctes(EXTRAS_SQL, STAGE_EXTRAS_SQL, REQUIRED_SQL) + "SELECT name FROM required")
def required_workflows(spark, sf_dir):
    return _required(spark, sf_dir)


@query("required_tasks", ctes(EXTRAS_SQL, STAGE_EXTRAS_SQL, REQUIRED_SQL) + """SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN 'task ' || l_partkey ELSE 'ref ' || l_suppkey END AS name
FROM lineitem WHERE l_orderkey * 10 + l_linenumber IN (SELECT name FROM required)
UNION SELECT 'own ' || o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def required_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("workflow"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("task "), F.col("l_partkey").cast("string"))).alias("name"),
        F.concat(F.lit("ref "), F.col("l_suppkey").cast("string")).alias("task_reference_name"))
    declared = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("own "), "o_orderpriority").alias("name"))
    return cat.required_tasks(tasks, _required(spark, sf_dir), declared)


@query("extends_closure", """WITH RECURSIVE edges AS (SELECT doc_id AS f, 0 AS pos, doc_id // 2 AS parent FROM documents WHERE doc_id > 0
  UNION ALL SELECT doc_id, 1, doc_id // 3 FROM documents WHERE doc_id > 2),
ways AS (SELECT doc_id AS f, doc_id AS a, CAST([] AS INT[]) AS at FROM documents
  UNION ALL SELECT w.f, e.parent, list_append(w.at, e.pos) FROM ways w JOIN edges e ON e.f = w.a),
own AS (SELECT doc_id AS a, 0 AS pos, source AS package FROM documents UNION ALL SELECT doc_id, 1, lang FROM documents),
placed AS (SELECT w.f, o.package, min(list_concat(w.at, [1000, o.pos])) AS place FROM ways w JOIN own o USING (a) GROUP BY w.f, o.package)
SELECT f AS feature, row_number() OVER (PARTITION BY f ORDER BY place) AS pos, package FROM placed""")
def extends_closure(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    edges = d.where("doc_id > 0").select(F.col("doc_id").alias("feature"), F.lit(0).alias("pos"), F.expr("doc_id DIV 2").alias("parent")).unionByName(
        d.where("doc_id > 2").select(F.col("doc_id").alias("feature"), F.lit(1).alias("pos"), F.expr("doc_id DIV 3").alias("parent")))
    own = d.select(F.col("doc_id").alias("feature"), F.posexplode(F.array("source", "lang")).alias("pos", "package"))
    return cat.extends_closure(d.select(F.col("doc_id").alias("feature")), edges, own)
