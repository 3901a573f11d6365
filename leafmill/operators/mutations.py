"""Batches of document and stage changes.

Each operator takes the table and a batch of change rows and returns new rows; nothing is written
here. Several changes of one target resolve by a numeric ``seq``. ``append_to_lists`` and ``add_refs`` give
list items and references as rows, one per item with its position, so a document that receives most of a batch is never
gathered in one task. ``write_lists`` and ``write_refs`` give the updated table, in which the lists of a document are part of its row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from leafmill.functions.attributes import false_if_null, try_json
from leafmill.functions.variants import get_at, is_open, items, no_items, set_at
from leafmill.model import DEFAULT_DOCUMENT_STATUS, DOC_REF, DOCUMENT_STATUS, DROPPABLE_STATUS, FILE_REF, STAGE_STATUS
from leafmill.operators.ranking import last_per_key, running_number


@dataclass(frozen=True)
class Change:
    """Accepted rows, and rejected change rows with an ``error`` text."""

    accepted: DataFrame
    rejects: DataFrame


def _known(changes: DataFrame, docs: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Split change rows by whether their document exists: one join, whose flag makes both halves."""
    ids = docs.select(key).distinct().withColumn("_there", F.lit(True))
    flagged = changes.join(ids, key, "left").select(*changes.columns, "_there")
    known = flagged.where("_there").drop("_there")
    return known, flagged.where("_there IS NULL").drop("_there").withColumn("error", F.lit("Document not found"))


# -- attributes -----------------------------------------------------------------------------


def _merge_attributes(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Overwrite flat keys of ``attrs`` with the (id, key, value VARIANT) rows, one per id and key."""
    new = values.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    old = F.coalesce(F.try_variant_get("attrs", "$", "map<string,variant>"), F.expr("CAST(map() AS MAP<STRING, VARIANT>)"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key("_new", k))
    merged = F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(F.to_variant_object(F.map_concat(kept, "_new")))
    return docs.join(new, "id", "left").withColumn("attrs", merged).drop("_new")


def set_attributes(docs: DataFrame, changes: DataFrame) -> Change:
    """``changes`` (id, seq, key, value): values stay text, dotted keys stay flat, the last one wins."""
    known, unknown = _known(changes, docs)
    last = last_per_key(known.select("id", "key", "seq", "value"), ["id", "key"], [F.col("seq")])
    values = last.select("id", "key", F.col("value").cast("variant").alias("value"))
    return Change(_merge_attributes(docs, values), unknown)


def set_json_attributes(docs: DataFrame, changes: DataFrame) -> Change:
    """The same with ``json`` text instead of ``value``; text that is no JSON is rejected."""
    known, unknown = _known(changes, docs)
    parsed = known.withColumn("value", try_json(F.col("json")))
    bad = parsed.where("value IS NULL").drop("value")
    last = last_per_key(parsed.where("value IS NOT NULL").select("id", "key", "seq", "json"), ["id", "key"], [F.col("seq")])
    values = last.select("id", "key", try_json(F.col("json")).alias("value"))
    rejects = unknown.unionByName(bad.withColumn("error", F.lit("invalid JSON")))
    return Change(_merge_attributes(docs, values), rejects)


def create(
    docs: DataFrame, new: DataFrame, sets: DataFrame | None = None, jsons: DataFrame | None = None, lists: DataFrame | None = None,
    doc_refs: DataFrame | None = None, file_refs: DataFrame | None = None, doc_data: DataFrame | None = None, file_data: DataFrame | None = None,
) -> Change:
    """Add ``new`` (id, status, body) with attributes and references to the table, whose columns all stay.

    A missing id gets a uuid and a missing status ``inbox``; a row with a stored id takes the place of the stored
    one, and of several new rows with one id the one with the greatest ``seq`` counts (without that column: status and body).
    Changes apply in the order ``sets`` (id, seq, key, value: flat keys), ``lists`` (id, seq, key, value: items at dotted keys),
    ``jsons`` (id, seq, key, json), ``doc_refs`` (id, seq, key, uuid) with ``doc_data`` (id, seq, json), ``file_refs`` (id, seq, key,
    filename, uuid) with ``file_data``. What is wrong is rejected by itself, as in the operators for stored documents: (id, seq, part, error).
    """
    order = [c for c in ("seq", "status", "body") if c in new.columns]
    named = last_per_key(new.where("id IS NOT NULL").select("id", "status", "body", *[c for c in order if c == "seq"]), ["id"], [F.col(c) for c in order])
    nameless = new.where("id IS NULL").select(F.uuid().alias("id"), "status", "body")
    reference = {name: docs.schema[name].dataType if name in docs.columns else ArrayType(t) for name, t in (("doc_refs", DOC_REF), ("file_refs", FILE_REF))}
    rows = named.select("id", "status", "body").unionByName(nameless).select(
        "id",
        F.coalesce("status", F.lit(DEFAULT_DOCUMENT_STATUS)).alias("status"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.to_variant_object(F.expr("CAST(map() AS MAP<STRING, VARIANT>)")).alias("attrs"),
        *[F.lit(None).cast(t).alias(name) for name, t in reference.items() if name in docs.columns or (name == "doc_refs" and doc_refs is not None) or (
            name == "file_refs" and file_refs is not None)],
    )
    rejects = []

    def apply(part: str, change: Change) -> DataFrame:
        rejects.append(change.rejects.select("id", "seq", F.lit(part).alias("part"), "error"))
        return change.accepted

    if sets is not None:
        rows = apply("set", set_attributes(rows, sets))
    if lists is not None:
        rows = apply("list", write_lists(rows, lists.withColumnRenamed("key", "path")))
    if jsons is not None:
        rows = apply("json", set_json_attributes(rows, jsons))
    for name, refs, data in (("doc_refs", doc_refs, doc_data), ("file_refs", file_refs, file_data)):
        if refs is not None:
            rows = apply(name, write_refs(rows, name, refs, data))
    kept = docs.join(named.select("id"), "id", "left_anti")
    bad = reduce(DataFrame.unionByName, rejects) if rejects else new.sparkSession.createDataFrame([], "id string, seq bigint, part string, error string")
    return Change(_union(kept.select(*docs.columns), rows), bad)


def _union(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored and new documents, whose references may hold data that the stored ones cannot."""
    for name in ("doc_refs", "file_refs"):
        if name in docs.columns and name in rows.columns and docs.schema[name].dataType != rows.schema[name].dataType:
            docs = docs.withColumn(name, _with_data(F.col(name), docs.schema[name].dataType.elementType))
    return docs.unionByName(rows, allowMissingColumns=True)


def create_documents(docs: DataFrame, new: DataFrame, *args, **kwargs) -> DataFrame:
    """The table after ``create``."""
    return create(docs, new, *args, **kwargs).accepted


def replace_body(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, seq, body): the last given body replaces the old one, null keeps it."""
    last = last_per_key(changes.where("body IS NOT NULL").select("id", "seq", "body"), ["id"], [F.col("seq")])
    joined = docs.join(last.select("id", F.col("body").alias("_body")), "id", "left")
    return joined.withColumn("body", F.coalesce("_body", "body")).drop("_body")


# -- lists and references -------------------------------------------------------------------


def append_to_lists(docs: DataFrame, changes: DataFrame, bucket: list[Column]) -> Change:
    """``changes`` (id, seq, path, value) append to list attributes at dotted paths; ``value`` is text or VARIANT.

    Missing lists and parents are created; a path that holds, or passes through, something else is
    rejected. ``accepted`` has every item of every touched list, each with its type: (id, path, pos,
    value VARIANT). ``bucket`` is a coarser form of ``seq``.
    """
    known, unknown = _known(changes, docs)
    touched = known.select("id", "path").distinct().join(docs.select("id", "attrs"), "id")
    parts = F.split("path", r"\.")
    here = get_at(F.col("attrs"), parts)
    state = touched.select(
        "id", "path", (is_open(F.col("attrs"), parts) & (here.isNull() | items(here).isNotNull())).alias("ok"),
        F.coalesce(items(here), no_items()).alias("items"))
    sized = state.select("id", "path", "ok", F.size("items").cast("bigint").alias("n"))
    marked = known.join(sized, ["id", "path"])
    bad = marked.where(~F.col("ok")).select(*changes.columns).withColumn("error", F.concat("path", F.lit(" is not a list.")))
    added = running_number(marked.where("ok").drop("ok"), ["id", "path"], ["seq"], bucket, "k")
    added = added.select("id", "path", (F.col("n") + F.col("k")).alias("pos"), F.col("value").cast("variant").alias("value"))
    old = state.where("ok").select("id", "path", F.posexplode("items").alias("pos", "value"))
    old = old.withColumn("pos", F.col("pos").cast("bigint") + 1)
    return Change(old.unionByName(added), unknown.unionByName(bad))


def add_refs(
    docs: DataFrame, refs: str, changes: DataFrame, bucket: list[Column], data: DataFrame | None = None
) -> Change:
    """``changes`` (id, seq, key, uuid, for files also filename) append references; ``data`` (id, seq, json) attaches to
    the last reference that the batch adds to the document.

    ``accepted`` has every reference with all it holds, ``data`` as JSON text: (id, pos, key, [filename,] uuid, data).
    """
    known, unknown = _known(changes, docs)
    reference = docs.schema[refs].dataType.elementType
    held = reference.names
    fields = [f for f in ("key", "filename", "uuid") if f in held]
    sizes = docs.select("id", F.greatest(F.size(refs), F.lit(0)).cast("bigint").alias("n"))
    given = [F.trim(f).alias(f) if f in changes.columns else F.lit(None).cast("string").alias(f) for f in fields]
    added = running_number(known, ["id"], ["seq"], bucket, "k").join(sizes, "id").select("id", (F.col("n") + F.col("k")).alias("pos"), *given)
    if "data" not in held:
        stored = F.lit(None).cast("string")
    else:
        stored = F.col("r.data") if isinstance(reference["data"].dataType, StringType) else F.to_json("r.data")
    old = docs.select("id", F.posexplode(refs).alias("pos", "r")).select(
        "id", (F.col("pos") + 1).cast("bigint").alias("pos"), *[F.col(f"r.{f}").alias(f) for f in fields], stored.alias("data"))
    if data is None:
        return Change(old.unionByName(added.withColumn("data", F.lit(None).cast("string"))), unknown)
    last_data = last_per_key(data.select("id", "seq", "json"), ["id"], [F.col("seq")])
    attach = added.groupBy("id").agg(F.max("pos").alias("pos")).join(last_data, "id").select("id", "pos", F.col("json").alias("data"))
    return Change(old.unionByName(added.join(attach, ["id", "pos"], "left")), unknown)


def _in_order(rows: Column, by: str) -> Column:
    """An array of structs in the order of one field; the others need not compare."""
    return F.array_sort(rows, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def write_lists(docs: DataFrame, changes: DataFrame) -> Change:
    """``append_to_lists`` into the table: ``accepted`` has every document, with the items in the lists of ``attrs``.

    A path that is a list for one change and an object for another is what its first change makes of it; the
    other changes are rejected. Keys may hold any character but the dot that separates them.
    """
    rest = [c for c in changes.columns if c not in ("id", "path")]
    by_path = changes.groupBy("id", "path").agg(_in_order(F.collect_list(F.struct(*rest)), "seq").alias("given"))
    batch = by_path.groupBy("id").agg(_in_order(F.collect_list(F.struct(F.col("given")[0]["seq"].alias("first"), "path", "given")), "first").alias("_steps"))

    def step(state: Column, change: Column) -> Column:
        parts = F.split(change["path"], r"\.")
        here = get_at(state["attrs"], parts)
        ok = is_open(state["attrs"], parts) & (here.isNull() | items(here).isNotNull())
        grown = F.concat(F.coalesce(items(here), no_items()), F.transform(change["given"], lambda g: g["value"].cast("variant")))
        return F.struct(
            F.when(ok, set_at(state["attrs"], parts, grown.cast("variant"))).otherwise(state["attrs"]).alias("attrs"),
            F.when(ok, state["bad"]).otherwise(F.array_append(state["bad"], change["path"])).alias("bad"))

    joined = docs.withColumn("_there", F.lit(True)).join(batch, "id", "full_outer")
    start = F.struct(F.col("attrs"), F.array().cast("array<string>").alias("bad"))
    done = joined.withColumn("_done", F.when(F.col("_there") & F.col("_steps").isNotNull(), F.aggregate("_steps", start, step)))
    accepted = done.where("_there").withColumn("attrs", F.coalesce("_done.attrs", "attrs")).select(docs.columns)
    refused = F.filter("_steps", lambda c: F.coalesce(F.array_contains(F.col("_done.bad"), c["path"]), F.col("_there").isNull()))
    rejects = (
        done.select("id", "_there", F.explode(refused).alias("c")).select("id", "_there", "c.path", F.explode("c.given").alias("g"))
        .select("id", "path", "g.*", F.when(F.col("_there"), F.concat("path", F.lit(" is not a list."))).otherwise("Document not found").alias("error")))
    return Change(accepted, rejects.select(*changes.columns, "error"))


def _with_data(refs: Column, reference: StructType) -> Column:
    """References whose element has a place for ``data``."""
    if "data" in reference.names:
        return refs
    return F.transform(refs, lambda r: F.struct(*[r[f].alias(f) for f in reference.names], F.lit(None).cast("variant").alias("data")))


def write_refs(docs: DataFrame, refs: str, changes: DataFrame, data: DataFrame | None = None) -> Change:
    """``add_refs`` into the table: ``accepted`` has every document, with the references in its array column ``refs``.

    ``data`` (id, seq, json) must be JSON; empty text is an empty object. It attaches to the last reference that the batch adds to the
    document; the last one counts. Without an added reference, data of files is rejected and data of documents ignored.
    ``rejects`` has (id, seq, key, [filename,] uuid, json, error).
    """
    reference = docs.schema[refs].dataType.elementType
    fields = [f for f in reference.names if f != "data"]
    given = {f: F.trim(f) if f in changes.columns else F.lit(None).cast("string") for f in fields}
    rows = changes.select("id", F.lit(False).alias("is_data"), "seq", *[c.alias(f) for f, c in given.items()], F.lit(None).cast("string").alias("json"))
    if data is not None:
        rows = rows.unionByName(data.select("id", F.lit(True).alias("is_data"), "seq", "json"), allowMissingColumns=True)
    batch = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "is_data", *fields, "json"))).alias("_rows"))
    joined = docs.withColumn("_there", F.lit(True)).join(batch, "id", "full_outer")
    parsed = joined.withColumn("_added", F.filter("_rows", lambda r: ~r["is_data"])).withColumn(
        "_data", F.transform(F.filter("_rows", lambda r: r["is_data"]), lambda r: F.struct(r.alias("row"), try_json(
            F.when(F.coalesce(r["json"], F.lit("")) == "", "{}").otherwise(r["json"])).alias("value"))))
    last = F.try_element_at(F.filter("_data", lambda d: d["value"].isNotNull()), F.lit(-1))
    has_data = "data" in reference.names or data is not None
    as_text = "data" in reference.names and isinstance(reference["data"].dataType, StringType)

    def made(r: Column, i: Column) -> Column:
        attached = F.when(i == F.size("_added") - 1, F.to_json(last["value"]) if as_text else last["value"])
        whole = {**{f: r[f] for f in fields}, **({"data": attached} if has_data else {})}
        return F.struct(*[whole[f].alias(f) for f in [*reference.names, *(["data"] if has_data and "data" not in reference.names else [])]])

    old = _with_data(F.col(refs), reference) if has_data else F.col(refs)
    new = F.transform("_added", made)
    accepted = parsed.where("_there").withColumn(refs, F.when(F.size("_added") > 0, F.concat(F.coalesce(old, F.slice(new, 1, 0)), new)).otherwise(old)).select(docs.columns)
    empty, of_files = F.size("_added") == 0, "filename" in reference.names
    wrong = (
        F.when(F.col("_there").isNull(), F.transform("_rows", lambda r: F.struct(r.alias("row"), F.lit("Document not found").alias("error"))))
        .when(empty, F.transform("_data", lambda d: F.struct(d["row"].alias("row"), F.lit("file data without an added file").alias("error"))) if of_files
              else F.lit(None))
        .otherwise(F.transform(F.filter("_data", lambda d: d["value"].isNull()), lambda d: F.struct(d["row"].alias("row"), F.lit("invalid JSON").alias("error")))))
    rejects = parsed.select("id", F.explode(wrong).alias("w")).select("id", "w.row.seq", *[f"w.row.{f}" for f in fields], "w.row.json", "w.error")
    return Change(accepted, rejects)


# -- status ---------------------------------------------------------------------------------


def set_status(docs: DataFrame, changes: DataFrame) -> Change:
    """``changes`` (id, seq, status). ``accepted``: (id, old_status, new_status) of every changed id."""
    known, unknown = _known(changes, docs)
    valid = F.col("status").isin(*DOCUMENT_STATUS)
    bad = known.where(~false_if_null(valid)).withColumn(
        "error", F.lit("status must be one of " + ", ".join(sorted(DOCUMENT_STATUS))))
    last = last_per_key(known.where(valid).select("id", "seq", "status"), ["id"], [F.col("seq")])
    moved = docs.select("id", F.col("status").alias("old_status")).join(
        last.select("id", F.col("status").alias("new_status")), "id")
    return Change(moved, unknown.unionByName(bad))


def drop_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id").distinct(), "id", "left_anti")


def drop_all(docs: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Remaining documents and the dropped ones, by status or ``all``; ``blocked`` is not offered."""
    if status not in DROPPABLE_STATUS:
        raise ValueError(f"Invalid status '{status}'. Must be one of: {', '.join(sorted(DROPPABLE_STATUS))}")
    hit = F.lit(True) if status == "all" else false_if_null(F.col("status") == status)
    return docs.where(~hit), docs.where(hit)


def validate_status(rows: DataFrame, allowed: tuple[str, ...] = DOCUMENT_STATUS) -> Change:
    valid = false_if_null(F.col("status").isin(*allowed))
    return Change(rows.where(valid), rows.where(~valid).withColumn("error", F.concat(F.lit("Invalid status: "), F.coalesce("status", F.lit("null")))))


def validate_parents(stages: DataFrame, parents: DataFrame) -> Change:
    """A stage belongs to a document: the parent id must be one, not a stage."""
    ids = parents.select("doc_id").distinct().withColumn("_there", F.lit(True))
    flagged = stages.join(ids, "doc_id", "left").select(*stages.columns, "_there")
    lost = flagged.where("_there IS NULL").drop("_there")
    return Change(flagged.where("_there").drop("_there"), lost.withColumn("error", F.lit("stage parent must be a document")))


# -- stages ---------------------------------------------------------------------------------


def add_stages(
    docs: DataFrame, stages: DataFrame, requests: DataFrame, definitions, bucket: list[Column], installed: set[str] = frozenset()
) -> Change:
    """``requests`` (doc_id, seq, name, workflow) start stages by hand.

    The counter goes on from the number of stored instances. A stage is ``active`` if its
    requirements are met by the stored state, else ``scheduled``. Unknown documents, stages and
    workflows are rejected.
    """
    from leafmill.operators.requirements import needed_states, requirements_met, with_stage_states

    known, unknown = _known(requests, docs, "doc_id")
    active = [d for d in definitions if d.active]
    names = F.array(*[F.lit(d.name) for d in active])
    flows = F.array(*[F.lit(f"{d.name}\u0000{w.name}") for d in active for w in d.workflows])
    has_stage = F.array_contains(names, F.col("name"))
    has_flow = F.col("workflow").isNull() | F.array_contains(flows, F.concat_ws("\u0000", "name", "workflow"))
    bad_stage = known.where(~has_stage).withColumn("error", F.concat(F.lit("Stage definition '"), "name", F.lit("' not found")))
    bad_flow = known.where(has_stage & ~has_flow).withColumn(
        "error", F.concat(F.lit("Workflow '"), "workflow", F.lit("' not found in stage '"), "name", F.lit("'")))
    good = known.where(has_stage & has_flow)

    base = with_stage_states(docs, stages, needed_states(active))
    met = base.select("doc_id", F.map_from_arrays(names, F.array(*[requirements_met(base, d, installed) for d in active])).alias("_met"))
    stored = stages.groupBy("doc_id", "name").agg(F.count("*").alias("_stored"))
    numbered = running_number(good, ["doc_id", "name"], ["seq"], bucket, "k")
    joined = numbered.join(stored, ["doc_id", "name"], "left").join(met, "doc_id")
    added = joined.select(
        "doc_id",
        "name",
        (F.coalesce("_stored", F.lit(0)) + F.col("k")).alias("counter"),
        F.when(F.col("_met")[F.col("name")], F.lit("active")).otherwise(F.lit("scheduled")).alias("status"),
        "seq",
    )
    return Change(added, unknown.unionByName(bad_stage).unionByName(bad_flow))


def update_stage_status(docs: DataFrame, stages: DataFrame, changes: DataFrame) -> Change:
    """``changes`` (doc_id, name, counter, seq, status). ``accepted`` reports old and new status."""
    known, unknown = _known(changes, docs, "doc_id")
    valid = false_if_null(F.col("status").isin(*STAGE_STATUS))
    bad = known.where(~valid).withColumn("error", F.concat(F.lit("Invalid stage status: "), F.coalesce("status", F.lit("null"))))
    last = last_per_key(known.where(valid).select("doc_id", "name", "counter", "seq", "status"), ["doc_id", "name", "counter"], [F.col("seq")])
    stored = stages.select("doc_id", "name", "counter", F.col("status").alias("old_status"))
    joined = last.join(stored, ["doc_id", "name", "counter"], "left")
    missing = joined.where("old_status IS NULL").drop("old_status").withColumn(
        "error", F.concat(F.lit("Stage "), "name", F.lit(" (counter "), F.col("counter").cast("string"), F.lit(") not found")))
    done = joined.where("old_status IS NOT NULL").select(
        "doc_id", "name", "counter", "old_status", F.col("status").alias("new_status"))
    return Change(done, unknown.unionByName(bad).unionByName(missing))


def normalise_result(doc: str = "doc") -> tuple[Column, Column]:
    """Body and header of a workflow result: text is the body; an object gives its ``body`` and, as
    header, its keys without body and content; any other value is a body in text form."""
    v = F.col(doc)
    kind = F.schema_of_variant(v)
    is_object = kind.startswith("OBJECT")
    body = F.when(is_object, F.coalesce(F.try_variant_get(v, "$.body", "string"), F.lit(""))).otherwise(
        F.coalesce(F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))), F.when(kind == "VOID", F.lit("None")),
                   F.try_variant_get(v, "$", "string"), F.to_json(v)))
    header = F.when(
        is_object,
        F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin("body", "content"))),
    ).otherwise(F.lit("{}"))
    return body, header


def persist_results(docs: DataFrame, stages: DataFrame, results: DataFrame) -> Change:
    """Store ``results`` (doc_id, name, counter, seq, workflow, doc VARIANT) under their stages.

    A result without ``doc`` stores nothing; the last result per stage and workflow wins.
    """
    known, unknown = _known(results.where("doc IS NOT NULL"), docs, "doc_id")
    # Two results of one stage are resolved before the join, so a hot stage joins only once per workflow.
    keys = ["doc_id", "name", "counter", "workflow"]
    body, header = normalise_result()
    rows = last_per_key(known.select(*keys, "seq", body.alias("body"), header.alias("header")), keys, [F.col("seq")])
    stored = stages.select("doc_id", "name", "counter", F.lit(True).alias("_there"))
    joined = rows.join(stored, ["doc_id", "name", "counter"], "left")
    missing = joined.where("_there IS NULL").select(*keys, "seq").withColumn(
        "error", F.concat(F.lit("Stage "), "name", F.lit(" with counter "), F.col("counter").cast("string"), F.lit(" not found")))
    rejects = unknown.select(*keys, "seq", "error").unionByName(missing)
    return Change(joined.where("_there").select(*keys, "header", "body"), rejects)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` in the same form: what a save has to write."""
    rest = [F.col(f"`{c}`") for c in new.columns if c not in keys]
    # as text, since neither VARIANT nor maps compare; the type of a value shows in its JSON form
    # and as a digest, so a body moves once and not three times
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    before = old.select(*keys, content.alias("_old"))
    joined = new.select("*", content.alias("_new")).join(before, keys, "left")
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*new.columns)
