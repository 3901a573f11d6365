"""Layered catalogs: overlay, origin, deep merge, sync diffs, requirements and extras."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafmill.functions.layers import merged_layers
from leafmill.functions.variants import entries, items
from leafmill.operators.ranking import last_per_key, running_number, top_k
from leafmill.session import materialise

# Run states that keep a version from being pruned.
ACTIVE_RUN_STATUS = ("RUNNING", "PENDING", "IN_PROGRESS", "SCHEDULED")


# -- layers ---------------------------------------------------------------------------------


def rank_layers(vendors: DataFrame, bucket: list[Column]) -> DataFrame:
    """Enabled vendors (name, priority, enabled) by priority and name; the library is rank 0."""
    enabled = vendors.where("enabled").select("name", "priority")
    return running_number(enabled, [], ["priority", "name"], bucket, "layer_rank")


def overlay(files: DataFrame, order: list[str], name: str = "name") -> DataFrame:
    """Per name the file of the last layer."""
    return last_per_key(files, [name], [F.col(c) for c in order])


def classify_origin(files: DataFrame, name: str = "name", lib: str = "lib", project: str = "project") -> DataFrame:
    """Where a name comes from: extended, vendor, standard or custom."""
    layer = F.col("layer")
    seen = files.groupBy(name).agg(
        F.bool_or(layer == project).alias("p"),
        F.bool_or(~layer.isin(lib, project)).alias("v"),
        F.bool_or(layer == lib).alias("l"),
    )
    origin = (
        F.when(F.col("p") & (F.col("l") | F.col("v")), "extended").when(F.col("v"), "vendor").when(F.col("l"), "standard").otherwise("custom")
    )
    return seen.select(name, origin.alias("origin"))


def names_by_layer(files: DataFrame) -> DataFrame:
    return files.select("layer", "name").distinct()


def effective_files(files: DataFrame, order: list[str]) -> DataFrame:
    """All files of the last layer that has the name (a directory overlays as a whole)."""
    winner = files.groupBy("name").agg(F.max(order[0]).alias(order[0]))
    return files.join(winner, ["name", order[0]], "left_semi")


def catalog_status(files: DataFrame, required: DataFrame) -> DataFrame:
    """Every name with its origin and whether it is required (active) or not (unused)."""
    need = required.select("name").distinct().withColumn("_needed", F.lit(True))
    joined = classify_origin(files).join(need, "name", "left")
    return joined.select("name", "origin", F.when(F.col("_needed"), "active").otherwise("unused").alias("status"))


def overview_extended(elements: DataFrame, project: DataFrame) -> DataFrame:
    """Elements per section and whether the project has one of the same name."""
    mine = project.select("section", "name").distinct().withColumn("_mine", F.lit(True))
    joined = elements.select("section", "name").distinct().join(mine, ["section", "name"], "left")
    return joined.select("section", "name", F.coalesce("_mine", F.lit(False)).alias("is_extended"))


# -- deep merge -----------------------------------------------------------------------------


#: Lists whose items merge by their ``name``.
KEYED_LISTS = ("workflows",)


@dataclass(frozen=True)
class _Levels:
    """Definitions taken apart. ``roots`` has the keys of every definition, ``levels[d]`` one row for each path
    of d + 1 steps: ``(*keys, path, kind, value, pos, at, bare)`` with the value of a leaf, layer and place of the last row, and whether
    an object or list may have nothing in it; ``hollow`` says that there are such ones.

    A step is a key (with a backslash in front if it starts with a bracket or a backslash) or, in a keyed list, ``[name]`` of an item;
    an item without a name has a step that no other one has.
    """

    keys: list[str]
    roots: DataFrame
    levels: list[DataFrame]
    hollow: bool

    def leaves(self) -> DataFrame:
        """``(*keys, path, value JSON)`` of the leaves and of objects and lists with nothing in them."""
        found = []
        for level, below in zip(self.levels, [*self.levels[1:], None], strict=True):
            found.append(level.where("kind = 'leaf'").select(*self.keys, "path", F.to_json("value").alias("value")))
            if below is not None and self.hollow:
                filled = below.select(*self.keys, _parent().alias("path")).distinct()
                empty = level.where("kind <> 'leaf' AND bare").join(filled, [*self.keys, "path"], "left_anti")
                found.append(empty.select(*self.keys, "path", F.when(F.col("kind") == "object", "{}").otherwise("[]").alias("value")))
        return reduce(DataFrame.unionByName, found)

    def definitions(self) -> DataFrame:
        """``(*keys, definition VARIANT)``: the values put together again, one level at a time from the deepest.

        Keyed lists are in the order of ``merged_list_order``: items without a name of earlier layers, the list of the last layer, the
        named items that no later layer repeats, newest layer first.
        """
        built, of_list = None, F.element_at("path", -1).startswith("[")
        for level in reversed(self.levels):
            rows = level.where("kind = 'leaf'").select(*self.keys, "path", "value", "at", "pos")
            open_ = level.where("kind <> 'leaf'")
            if built is not None or self.hollow:
                # below the deepest level there is nothing
                nothing = F.lit(None).cast(_MEMBERS.format(at=level.schema["at"].dataType.simpleString()))
                open_ = open_.withColumn("members", nothing) if built is None else open_.join(built, [*self.keys, "path"], "left")
                made = F.when(F.col("kind") == "object", _object_of(F.col("members"))).otherwise(_list_of(F.col("members"), F.col("at")))
                rows = rows.unionByName(open_.select(*self.keys, "path", made.alias("value"), "at", "pos"))
            # only the order of a list asks for the layer
            member = F.struct(F.element_at("path", -1).alias("step"), "value", F.when(of_list, F.col("at")).alias("at"), F.when(of_list, F.col("pos")).alias("pos"))
            built = rows.groupBy(*self.keys, _parent().alias("path")).agg(F.collect_list(member).alias("members"))
        return self.roots.join(built.drop("path"), self.keys, "left").select(*self.keys, _object_of(F.col("members")).alias("definition"))


@dataclass(frozen=True)
class Merged:
    """Definitions merged over their layers, ``keys`` name them.

    ``parts`` are the files, those of one definition in one task but in the last part, if it is of definitions with very many files.
    """

    keys: list[str]
    order: list[str]
    payload: str
    keyed_lists: tuple[str, ...]
    parts: list[DataFrame]

    def leaves(self) -> DataFrame:
        """``(*keys, path, value JSON)`` of the leaves and of objects and lists with nothing in them."""
        return self._levels(self.parts).leaves()

    def definitions(self) -> DataFrame:
        """``(*keys, definition VARIANT)``.

        Keyed lists are in the order of ``merged_list_order``: items without a name of earlier layers, the list of the last layer, the
        named items that no later layer repeats, newest layer first. The files of a definition are merged one after the other by the
        task that has them; those of definitions with very many files are taken apart and put together again.
        """
        few = self.parts[0].sortWithinPartitions(*self.keys, *self.order)
        fields = few.schema
        schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in self.keys), "definition variant"])
        found = materialise(few.mapInArrow(merged_layers(self.keys, self.order, self.payload, self.keyed_lists), schema), "merged")
        return found.unionByName(self._levels(self.parts[1:]).definitions()) if self.parts[1:] else found

    def _levels(self, parts: list[DataFrame]) -> _Levels:
        return _opened_levels(parts, self.keys, self.order, self.payload, self.keyed_lists)


#: Members of an object or list, as ``definitions`` gathers them.
_MEMBERS = "array<struct<step: string, value: variant, at: {at}, pos: int>>"


def _parent() -> Column:
    return F.slice("path", F.lit(1), F.size("path") - 1)


def _object_of(members: Column) -> Column:
    def entry(m: Column) -> Column:
        key = F.when(m["step"].startswith("\\"), F.substring(m["step"], 2, 2**31 - 1)).otherwise(m["step"])
        return F.struct(key.alias("key"), m["value"].alias("value"))

    entries = F.transform(F.coalesce(members, F.slice(members, 1, 0)), entry)
    return F.to_variant_object(F.when(F.size(members) > 0, F.map_from_entries(entries)).otherwise(F.create_map().cast("map<string,variant>")))


def _list_of(members: Column, last: Column) -> Column:
    def before(a: Column, b: Column) -> Column:
        group = lambda m: F.when(m["at"] == last, 1).when(m["step"].startswith("[#:"), 0).otherwise(2)
        layer = F.when(a["at"] == b["at"], 0).when((a["at"] < b["at"]) == (group(a) == 0), -1).otherwise(1)
        return F.when(group(a) != group(b), group(a) - group(b)).when(layer != 0, layer).otherwise(a["pos"] - b["pos"])

    values = F.transform(F.array_sort(members, before), lambda m: m["value"])
    return F.coalesce(values, F.array().cast("array<variant>")).cast("variant")


#: Files of one definition above which they are spread over tasks.
MANY = 10_000
#: Files that one task takes.
SHARE = 100_000
#: Levels that are opened in one pass.
STEPS = 4


def deep_merge(definitions: DataFrame, keys: list[str], order: list[str], payload: str = "payload", keyed_lists: tuple[str, ...] = KEYED_LISTS) -> Merged:
    """Merge the layers of definitions: objects and keyed lists (by the ``name`` of their items) merge, everything else is replaced.

    ``definitions`` has the keys, the columns of ``order`` that sort the layers, and a VARIANT. The files of a definition move to one task
    once; those of a definition with more than ``MANY`` of them are spread and reduced in two steps.
    """
    spark, at = definitions.sparkSession, F.struct(*order)
    rows = definitions.select(*dict.fromkeys([*keys, *order, payload]))
    counts = definitions.groupBy(*keys).agg(F.count("*").alias("_n"))
    files, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, files // SHARE + 1)
    parts = [rows.repartition(tasks, *keys)]
    if most > MANY:
        many = materialise(counts.where(F.col("_n") > MANY).select(*keys), "many-layers")
        parts = [rows.join(many, keys, "left_anti").repartition(tasks, *keys), rows.join(many, keys, "left_semi").repartition(tasks, *keys, at)]
    return Merged(keys, order, payload, keyed_lists, parts)


def _opened_levels(parts: list[DataFrame], keys: list[str], order: list[str], payload: str, keyed_lists: tuple[str, ...]) -> _Levels:
    """All paths of the files are opened, ``STEPS`` levels in a pass, and reduced to one row for each path, which says what the last
    file has there. A row stays if it is of a later layer than the last row of another kind at any path above; that is passed down
    level by level. All steps are aggregates and joins on (keys, path), so the work grows with the size of the definitions, and
    neither a deep definition nor one with very many layers is gathered in one task.
    """
    at = F.struct(*order)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    parts = [part.where(F.schema_of_variant(payload).startswith("OBJECT")).select(
        *keys, at.alias("at"), F.array().cast("array<string>").alias("path"), F.lit("object").alias("kind"), F.col(payload).alias("value"),
        F.lit(0).alias("pos"), F.lit(False).alias("bare")) for part in parts]

    def opened(rows: DataFrame, depth: int) -> DataFrame:
        """The rows, and in place of each object or list of ``depth`` steps a row without value and one for each of its members."""
        def member(m: Column, of_list: bool) -> Column:
            key, value, shape, pos = m["key"], m["value"], m["shape"], m["pos"]
            if of_list:
                name = F.when(shape.startswith("OBJECT"), F.try_variant_get(value, "$.name", "string"))
                step = F.concat(F.lit("["), F.coalesce(name, F.concat_ws(":", F.lit("#"), *[F.col(f"at.{c}").cast("string") for c in order], pos)), F.lit("]"))
                kind = F.when(shape.startswith("OBJECT"), "object").otherwise("leaf")
            else:
                step = F.when(key.rlike(r"^[\[\\]"), F.concat(F.lit("\\"), key)).otherwise(key)
                kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY") & key.isin(*keyed_lists), "list").otherwise("leaf")
            bare = shape.isin("OBJECT<>", "ARRAY<VOID>") | ~known
            return F.struct(F.array_append("path", step).alias("path"), kind.alias("kind"), value.alias("value"), pos.alias("pos"), bare.alias("bare"))

        def shaped(key: Column, value: Column, pos: Column) -> Column:
            return F.struct(key.alias("key"), value.alias("value"), F.schema_of_variant(value).alias("shape"), pos.alias("pos"))

        of_object = F.transform(F.map_entries(entries(F.col("value"))), lambda e, i: shaped(e["key"], e["value"], i))
        of_list = F.transform(items(F.col("value")), lambda v, i: shaped(F.lit(None).cast("string"), v, i))
        inside = F.when(F.col("kind") == "object", F.transform(of_object, lambda m: member(m, False))).otherwise(F.transform(of_list, lambda m: member(m, True)))
        is_open = (F.size("path") == depth) & (F.col("kind") != "leaf") & (known | (F.size("path") == 0))
        own = F.struct("path", "kind", F.when(~is_open, F.col("value")).alias("value"), "pos", "bare")
        every = F.when(is_open, F.concat(F.array(own), inside)).otherwise(F.array(own))
        return rows.select(*keys, "at", F.inline(every).alias("path", "kind", "value", "pos", "bare"))

    def reduced(nodes: DataFrame) -> DataFrame:
        last_of = lambda k: F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"{k}_at")
        row = F.struct("kind", F.when(F.col("kind") == "leaf", F.col("value")).alias("value"), "pos", "bare")
        last = nodes.groupBy(*keys, "path").agg(F.max_by(row, "at").alias("row"), F.max("at").alias("at"), last_of("object"), last_of("list"), last_of("leaf"))
        cut = F.when(F.col("row.kind") == "object", F.greatest("list_at", "leaf_at")).when(F.col("row.kind") == "list", F.greatest("object_at", "leaf_at")).when(
            F.coalesce("object_at", "list_at").isNotNull(), F.col("at"))  # a leaf ends all that was below
        return last.select(*keys, "path", "row.*", "at", cut.alias("cut")).withColumn(
            "bare", F.col("bare") | F.coalesce(~(F.col("at") > F.col("cut")), F.lit(False)))

    roots, found, done, hollow, cuts = None, [], 0, False, False
    while True:
        nodes = parts
        for depth in range(done, done + STEPS):
            nodes = [opened(n, depth) for n in nodes]
        first, done = done + 1, done + STEPS  # the first pass also has a row for each definition itself, without a path
        if first > 1:  # what was there before this pass is known
            nodes = [n.where(F.size("path") >= first) for n in nodes]
        ends = (F.size("path") == done) & (F.col("kind") != "leaf") & known
        seen = Observation()
        rows = reduce(DataFrame.unionByName, [reduced(n) for n in nodes]).withColumn("depth", F.size("path"))
        rows = rows.observe(seen, F.max("depth").alias("depth"), F.count_if((F.col("kind") != "leaf") & F.col("bare")).alias("bare"), F.count_if(F.col("cut").isNotNull()).alias("cuts"),
                            F.count_if((F.col("depth") == done) & ((F.col("kind") != "leaf") | F.col("cut").isNotNull())).alias("open"))
        rows = materialise(rows, "merged")
        if roots is None:
            roots = rows.where("depth = 0").select(*keys)
        hollow, cuts = hollow or seen.get["bare"] > 0, cuts or seen.get["cuts"] > 0
        found += [rows.where(F.col("depth") == d).drop("depth") for d in range(first, max(first, seen.get["depth"] or 0) + 1)]
        if seen.get["open"] == 0:
            break
        parts = [materialise(n.where(ends), "merged-open") for n in nodes]
    return _Levels(keys, roots, _alive(found, keys) if cuts else [level.drop("cut") for level in found], hollow)


def _alive(levels: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """The rows of each level that are later than every cut above them."""
    alive, above = [levels[0].drop("cut")], levels[0].where("cut IS NOT NULL").select(*keys, "path", F.col("cut").alias("over"))
    for level in levels[1:]:
        below = level.withColumn("_parent", _parent()).join(above.withColumnRenamed("path", "_parent"), [*keys, "_parent"], "left").drop("_parent")
        alive.append(below.where("over IS NULL OR at > over").drop("cut", "over"))
        above = materialise(below.select(*keys, "path", F.greatest("cut", "over").alias("over")).where("over IS NOT NULL"), "merged-cuts") if level is not levels[-1] else None
    return alive


def merged_list_order(items: DataFrame, owner: str, order: str, bucket: list[Column]) -> DataFrame:
    """Order of a list merged by item name over layers, ``(owner, item, layer, item_no, pos)``.

    ``items`` (owner, item, ``order``, item_no): ``item`` is null for items without a name. Unnamed
    items of earlier layers come first, then the list of the last layer in its order, then the
    named items that no later layer repeats, newest layer first.
    """
    # The sort key of every survivor has a closed form, so no layer-by-layer loop is needed.
    last_layer = items.groupBy(owner).agg(F.max(order).alias("_last"))
    named = items.where("item IS NOT NULL").groupBy(owner, "item").agg(
        F.max(order).alias(order), F.max_by("item_no", order).alias("item_no"))
    unnamed = items.where("item IS NULL").select(owner, "item", order, "item_no")
    every = named.unionByName(unnamed).join(last_layer, owner)
    is_last, is_named = F.col(order) == F.col("_last"), F.col("item").isNotNull()
    every = every.withColumns({
        "_group": F.when(is_last, 1).when(is_named, 2).otherwise(0),
        "_layer": F.when(is_last, 0).when(is_named, -F.col(order)).otherwise(F.col(order)),
    })
    ranked = running_number(every, [owner], ["_group", "_layer", "item_no"], [F.col("_group"), F.col("_layer"), *bucket], "pos")
    return ranked.select(owner, "item", order, "item_no", "pos")


# -- local against remote -------------------------------------------------------------------


def sync_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, state) with state only_local, only_remote or common, by one full outer join."""
    left = local.select("name").distinct().withColumn("_l", F.lit(True))
    right = remote.select("name").distinct().withColumn("_r", F.lit(True))
    state = F.when(F.col("_r").isNull(), "only_local").when(F.col("_l").isNull(), "only_remote").otherwise("common")
    return left.join(right, "name", "full").select("name", state.alias("state"))


def sync_counts(local: DataFrame, remote: DataFrame) -> DataFrame:
    state = F.col("state")
    return sync_status(local, remote).agg(
        F.count_if(state != "only_remote").alias("local"),
        F.count_if(state != "only_local").alias("remote"),
        F.count_if(state == "common").alias("common"),
        F.count_if(state == "only_local").alias("only_local"),
        F.count_if(state == "only_remote").alias("only_remote"),
    )


def _versions(df: DataFrame) -> DataFrame:
    return df.select("name", F.coalesce("version", F.lit(1)).alias("version")).distinct()


def missing_versions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Exact (name, version) pairs that the remote side lacks; a missing version is 1."""
    return _versions(local).join(_versions(remote), ["name", "version"], "left_anti")


def upload_plan(local: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """What an upload does with every local definition: uploaded, skipped or failed (no name)."""
    there = _versions(remote).withColumn("_there", F.lit(True))
    mine = local.select("name", F.coalesce("version", F.lit(1)).alias("version"))
    joined = mine.join(there, ["name", "version"], "left")
    skip = F.col("_there").isNotNull() & F.lit(not force)
    return joined.select("name", "version", F.when(F.col("name").isNull(), "failed").when(skip, "skipped").otherwise("uploaded").alias("state"))


def upload_summary(plan: DataFrame) -> DataFrame:
    state = F.col("state")
    return plan.agg(
        F.count_if(state == "uploaded").alias("uploaded"),
        F.count_if(state == "skipped").alias("skipped"),
        F.count_if(state == "failed").alias("failed"),
        F.count("*").alias("total"),
    )


def versions_per_name(remote: DataFrame) -> DataFrame:
    """Sorted versions of each name as ``v1, v2``; the distinct pairs are reduced in the map tasks."""
    grouped = _versions(remote).groupBy("name").agg(F.sort_array(F.collect_list("version")).alias("versions"))
    return grouped.select("name", F.array_join(F.transform("versions", lambda v: F.concat(F.lit("v"), v.cast("string"))), ", ").alias("versions"))


def active_runs(runs: DataFrame, samples: int = 3) -> DataFrame:
    """Active runs per (name, version): their number and the first few run ids."""
    active = runs.where(F.upper("status").isin(*ACTIVE_RUN_STATUS))
    counts = active.groupBy("name", "version").agg(F.count("*").alias("n"))
    first = top_k(active, ["name", "version"], [F.col("run_id")], samples)
    shown = first.groupBy("name", "version").agg(F.sort_array(F.collect_list("run_id")).alias("ids"))
    return counts.join(shown, ["name", "version"]).select(
        "name", "version", "n", F.array_join(F.transform("ids", lambda r: r.cast("string")), ",").alias("samples"))


def prune_plan(local: DataFrame, remote: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Versions of names that exist remotely only, with their active runs and what to do."""
    extra = _versions(remote).join(local.select("name").distinct(), "name", "left_anti")
    active = runs.where(F.upper("status").isin(*ACTIVE_RUN_STATUS)).groupBy("name", "version").agg(F.count("*").alias("_n"))
    joined = extra.join(active, ["name", "version"], "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select("name", "version", n.alias("active_runs"), F.when((n == 0) | F.lit(force), "delete").otherwise("skip").alias("action"))


def orphan_tasks(local_tasks: DataFrame, remote_tasks: DataFrame, workflow_tasks: DataFrame) -> DataFrame:
    """Tasks known remotely only, and whether any workflow still uses them."""
    orphans = remote_tasks.select("name").distinct().join(local_tasks.select("name"), "name", "left_anti")
    used = workflow_tasks.select("name").distinct().withColumn("_used", F.lit(True))
    return orphans.join(used, "name", "left").select("name", F.coalesce("_used", F.lit(False)).alias("in_use"))


# -- what the definitions need --------------------------------------------------------------


def satisfied_extras(requirements: DataFrame, installed: DataFrame, extras: DataFrame) -> DataFrame:
    """(extra, n_packages, listed, usable) for every known extra.

    ``requirements`` (extra, package). ``listed``: every package is installed, which an extra
    without packages also satisfies. ``usable`` for a stage gate: it also has at least one package.
    """
    have = installed.select("package").distinct().withColumn("_have", F.lit(True))
    joined = requirements.join(have, "package", "left")
    done = joined.groupBy("extra").agg(F.count("*").alias("n"), F.count("_have").alias("have"))
    every = extras.select("extra").distinct().join(done, "extra", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce(F.col("n") == F.col("have"), F.lit(True))
    return every.select("extra", n.alias("n_packages"), ok.alias("listed"), (ok & (n > 0)).alias("usable"))


def extras_report(satisfied: DataFrame) -> DataFrame:
    return satisfied.agg(
        F.count("*").alias("available"), F.count_if("listed").alias("installed"), F.coalesce(F.bool_and("listed"), F.lit(True)).alias("all_installed"))


def extras_to_stages(definitions: DataFrame, stage_extras: DataFrame) -> DataFrame:
    """(extra, stage) of the active definitions, each pair once."""
    active = definitions.where("active").select(F.col("name").alias("stage"))
    return stage_extras.select("extra", "stage").distinct().join(active, "stage", "left_semi")


def required_workflows(definitions: DataFrame, stage_extras: DataFrame, usable: DataFrame, stage_workflows: DataFrame) -> DataFrame:
    """Workflow names of the active definitions whose extras are all usable.

    ``definitions`` (name, active), ``stage_extras`` (stage, extra), ``usable`` (extra),
    ``stage_workflows`` (stage, workflow).
    """
    unmet = stage_extras.join(usable.select("extra").distinct(), "extra", "left_anti").select("stage").distinct()
    good = definitions.where("active").select(F.col("name").alias("stage")).join(unmet, "stage", "left_anti")
    return stage_workflows.join(good, "stage", "left_semi").select(F.col("workflow").alias("name")).distinct()


def required_tasks(workflow_tasks: DataFrame, required: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Task names of the required workflows: the name, else the reference name. ``declared`` (name)
    adds the tasks that active definitions ask for themselves."""
    hit = workflow_tasks.join(required.select(F.col("name").alias("workflow")).distinct(), "workflow", "left_semi")
    names = hit.select(F.coalesce(F.nullif("name", F.lit("")), "task_reference_name").alias("name")).where("name IS NOT NULL")
    return (names if declared is None else names.union(declared.select("name"))).distinct()


def extends_closure(features: DataFrame, extends: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages of every feature, ancestors first: ``(feature, pos, package)``.

    ``extends`` (feature, pos, parent) and ``packages`` (feature, pos, package) are ordered lists. The
    packages of the parents come before the own ones, in list order, each package once at its
    first place. Ways to ancestors are joined with ways, so their length doubles with every round. A way that would visit a feature
    twice is not followed; only features that reach a cycle take the slower walk which looks for that.
    """
    features = features.select("feature").distinct()
    edges = materialise(extends.select("feature", F.col("pos").cast("bigint").alias("pos"), "parent"), "extends")
    own = packages.select(F.col("feature").alias("ancestor"), F.col("pos").cast("bigint").alias("pos"), "package")
    if not _has_circle(edges):
        return _first_places(features, edges, own)
    reach = _reach(edges)
    circles = reach.where(F.col("feature") == F.col("ancestor")).select("ancestor")
    tangled = materialise(reach.join(circles, "ancestor", "left_semi").select("feature").distinct(), "tangled")
    free = _first_places(features.join(tangled, "feature", "left_anti"), edges.join(tangled, "feature", "left_anti"), own)
    placed = _simple_ways(features.join(tangled, "feature", "left_semi"), edges).join(own, "ancestor")
    firsts = placed.groupBy("feature", "package").agg(F.min(F.concat(_place("at"), F.array("pos"))).alias("_p"))
    return free.unionByName(firsts.select(
        "feature", F.row_number().over(Window.partitionBy("feature").orderBy("_p")).cast("bigint").alias("pos"), "package"))


#: Rounds in which edges that no circle can hold are taken off before pairs are listed.
PEELS = 12


def _has_circle(edges: DataFrame) -> bool:
    """Whether any feature reaches itself. An edge lies on a circle only if its feature is a parent and its parent has
    one; the others go first, which leaves nothing of a hierarchy that is not very deep."""
    left = materialise(edges.select("feature", "parent").distinct(), "peeled")
    size = left.count()
    for _ in range(PEELS):
        if not size:
            return False
        inner = left.join(left.select(F.col("parent").alias("feature")).distinct(), "feature", "left_semi")
        inner = materialise(inner.join(left.select(F.col("feature").alias("parent")).distinct(), "parent", "left_semi").select("feature", "parent"), "peeled")
        before, size = size, inner.count()
        left = inner
        if size == before:
            break  # only circles and what lies between them
    return not _reach(left).where(F.col("feature") == F.col("ancestor")).isEmpty()


def _reach(edges: DataFrame) -> DataFrame:
    """Every (feature, ancestor) pair, in about as many rounds as the longest of the shortest ways has binary digits."""
    reach = materialise(edges.select("feature", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("steps")).distinct(), "reach")
    size = 1
    while True:
        longest = reach.where(F.col("steps") == size).select("feature", F.col("ancestor").alias("_mid"))
        if longest.isEmpty():
            return reach.select("feature", "ancestor")
        on = reach.select(F.col("feature").alias("_mid"), "ancestor", (F.col("steps") + size).alias("steps"))
        further = longest.join(on, "_mid").select("feature", "ancestor", "steps")
        reach = materialise(reach.unionByName(further).groupBy("feature", "ancestor").agg(F.min("steps").alias("steps")), "reach")
        size *= 2


def _first_places(features: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """``(feature, pos, package)`` without cycles.

    After a round, each feature has the ends of its ways of exactly ``2 ** round`` steps and the packages at the end of shorter ones, one
    row each, in the order in which a walk comes by (the packages of a feature after all its ways). Of several ways to one end, or
    places of one package, only the first counts: whatever follows a later one has a place before. A way and what follows from
    its end compare by two of these ranks, so neither ways nor pairs of features are written out.
    """
    def ranked(rows: DataFrame) -> DataFrame:
        best = rows.repartition("feature").groupBy("feature", "ancestor", "package", "is_way").agg(F.min("place").alias("place"))
        rank = F.row_number().over(Window.partitionBy("feature").orderBy("place")).cast("bigint")
        return materialise(best.select("feature", "ancestor", "package", "is_way", rank.alias("rank")), "ways")

    def no(df: DataFrame, column: str) -> Column:
        return F.lit(None).cast(df.schema[column].dataType).alias(column)

    def place(first: Column, then: Column) -> Column:
        return F.struct(first.alias("first"), then.alias("then")).alias("place")

    zero, last = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = ranked(
        edges.select("feature", F.col("parent").alias("ancestor"), no(own, "package"), F.lit(True).alias("is_way"), place(zero, F.col("pos")))
        .unionByName(own.select(F.col("ancestor").alias("feature"), no(edges, "parent").alias("ancestor"), "package", F.lit(False).alias("is_way"), place(last, F.col("pos")))))
    while True:
        ways = rows.where("is_way AND ancestor IS NOT NULL").select("feature", F.col("ancestor").alias("_mid"), F.col("rank").alias("_first"))
        if ways.isEmpty():
            # a way to no ancestor has a rank too, so packages are counted again
            pos = F.row_number().over(Window.partitionBy("feature").orderBy("rank")).cast("bigint")
            return rows.where("NOT is_way").join(features, "feature", "left_semi").select("feature", pos.alias("pos"), "package")
        further = ways.join(rows.withColumnRenamed("feature", "_mid"), "_mid").select(
            "feature", "ancestor", "package", "is_way", place(F.col("_first"), F.col("rank")))
        rows = ranked(further.unionByName(rows.where("NOT is_way").select("feature", "ancestor", "package", "is_way", place(F.col("rank"), zero))))


def _simple_ways(features: DataFrame, edges: DataFrame) -> DataFrame:
    """``(feature, ancestor, at)`` where ways may run into cycles: one step a round, each way with the features it has visited.

    ``at`` is the place of an ancestor in the final list: the positions on the way there. The
    marker of ``_place`` after the last position sorts the own packages behind those of all parents.
    """
    found = features.select("feature", F.col("feature").alias("ancestor"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("at"),
                            F.array("feature").alias("way"))
    found = materialise(found, "closure")
    frontier = found
    edges = edges.withColumnRenamed("feature", "ancestor")
    while not frontier.isEmpty():
        step = frontier.join(edges, "ancestor").where(~F.array_contains("way", F.col("parent")))
        step = step.select("feature", F.col("parent").alias("ancestor"), F.concat("at", F.array("pos")).alias("at"),
                           F.concat("way", F.array("parent")).alias("way"))
        best = step.unionByName(found).groupBy("feature", "ancestor").agg(F.min_by(F.struct("at", "way"), _place("at")).alias("_b"))
        best = materialise(best.select("feature", "ancestor", "_b.at", "_b.way"), "closure")
        fresh = best.join(found.select("feature", "ancestor", F.col("at").alias("_old")), ["feature", "ancestor"], "left")
        frontier = fresh.where(~F.col("_old").eqNullSafe(F.col("at"))).drop("_old")
        found = best
    return found.select("feature", "ancestor", "at")


def _place(at: str) -> Column:
    return F.concat(F.col(at), F.array(F.lit(2**62).cast("bigint")))


# -- names ----------------------------------------------------------------------------------


def names_union(*layers: DataFrame) -> DataFrame:
    names = layers[0].select("name")
    for other in layers[1:]:
        names = names.union(other.select("name"))
    return names.distinct()


def names_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").subtract(b.select("name"))


def names_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))


def missing_and_extraneous(required: DataFrame, installed: DataFrame) -> DataFrame:
    missing = required.select("extra").subtract(installed.select("extra")).select(F.lit("missing").alias("kind"), "extra")
    extraneous = installed.select("extra").subtract(required.select("extra")).select(F.lit("extraneous").alias("kind"), "extra")
    return missing.unionByName(extraneous)
