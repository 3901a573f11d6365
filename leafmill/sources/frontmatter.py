"""Documents and stages as Markdown files with YAML frontmatter, one folder per document.

Layout: ``<base>/<status>/<id>/doc.md`` and ``<base>/<status>/<id>/stages/<name>/<counter>/stage.md``.

A file and a folder for every stage fill a disk with their blocks and a driver with their names. So a tree can also lie in
bundles, Parquet files with many small files each (``write_bundles``); the readers take them with ``bundled=True``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.model import DOC_REF, DOCUMENT_STATUS, FILE_REF
from leafmill.session import materialise

_STATUS = "|".join(DOCUMENT_STATUS)
_BUNDLES = "bundles"
_BUNDLED = "path string, value string, length bigint, top string"


# -- reading --------------------------------------------------------------------------------


def _file_path() -> Column:
    """Path of the file that a row comes from, as it is written on disk (Spark gives it percent-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files as ``(path, value)``; many small files share a partition."""
    return spark.read.text(paths, wholetext=True).select(_file_path().alias("path"), "value")


def read_bundles(spark: SparkSession, base: str, tops: tuple[str, ...] | None = None) -> DataFrame:
    """The bundled files of ``base`` as ``(path, value, length)``; a choice of top folders reads only these."""
    files = spark.read.schema(_BUNDLED).parquet(f"{base}/{_BUNDLES}")
    chosen = files if tops is None else files.where(F.col("top").isin(*tops))
    return chosen.select(F.concat(F.lit(f"{base}/"), "path").alias("path"), "value", "length")


def read_bundled_texts(spark: SparkSession, base: str, patterns: str | list[str]) -> DataFrame:
    """Whole bundled files as ``(path, value)`` whose paths below ``base`` match; ``*`` and ``?`` stay in one folder."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    tops = [p.split("/")[0] for p in patterns]
    texts = read_bundles(spark, base, None if any(c in t for t in tops for c in "*?") else tuple(tops))
    names = "|".join(re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in patterns)
    return texts.where(F.substr("path", F.lit(len(base) + 2)).rlike(f"^(?:{names})$")).select("path", "value")


def read_tree(spark: SparkSession, base: str, statuses: tuple[str, ...], name: str, bundled: bool = False) -> DataFrame:
    """All files called ``name`` below the status folders; large folders are listed by a Spark job."""
    if bundled:
        return read_bundles(spark, base, statuses).where(F.col("path").endswith(f"/{name}")).select("path", "value")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    texts = reader.text(f"{base}/{{{','.join(statuses)}}}", wholetext=True)
    return texts.select(_file_path().alias("path"), "value")


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """YAML head and body. A text that does not start with three dashes is all body."""
    marked = text.startswith("---")
    parts = F.split(text, "\n---\n", 2)
    head = F.regexp_replace(parts[0], r"\A(---\n|-+)", "")
    return F.when(marked, head), F.when(marked, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(text)


@F.pandas_udf(T.StringType())
def yaml_to_json(heads: pd.Series) -> pd.Series:
    """YAML mappings as JSON text; null where the text is broken or no mapping."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def convert(head):
        if head is None:
            return "{}"
        try:
            data = yaml.load(head, Loader=loader)
            data = {} if data is None or data == "" else data
            if not isinstance(data, dict):
                return None
            return json.dumps({str(k): v for k, v in data.items()}, default=str, ensure_ascii=False, allow_nan=False)
        except Exception:  # a date that is none, not a number, a mapping that holds itself: the file is corrupt, not the job
            return None

    return heads.map(convert, na_action=None)


def parse_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``(path, value)`` as documents and the corrupt ones (bad YAML, unknown status).

    Internal keys (a leading underscore) are dropped apart from the two reference lists. The
    status is the one in the document; ``folder_status`` is where the file lies.
    """
    head, body = split_frontmatter(F.col("value"))
    # written once, so the good and the corrupt ones do not parse all YAML twice
    raw = materialise(texts.select("path", head.alias("head"), body.alias("body")).select("path", "body", yaml_to_json("head").alias("json")), "parsed")
    v = raw.withColumn("all", F.coalesce(F.try_parse_json("json"), F.parse_json(F.lit("{}"))))
    get = lambda key: F.try_variant_get("all", f"$.{key}", "string")
    public = F.map_filter(F.try_variant_get("all", "$", "map<string,variant>"), lambda k, _: ~k.startswith("_"))
    parsed = v.select(
        "path",
        F.coalesce(get("id"), _from_path(2)).alias("id"),
        F.coalesce(get("status"), F.lit("inbox")).alias("status"),
        _from_path(3).alias("folder_status"),
        F.to_variant_object(F.map_filter(public, lambda k, _: ~k.isin("id", "status"))).alias("attrs"),
        "body",
        F.from_json(F.to_json(F.try_variant_get("all", "$._doc_refs", "variant")), _array_of(DOC_REF)).alias("doc_refs"),
        F.from_json(F.to_json(F.try_variant_get("all", "$._file_refs", "variant")), _array_of(FILE_REF)).alias("file_refs"),
        F.when(F.try_parse_json("json").isNull(), "bad frontmatter").when(~F.coalesce(get("status"), F.lit("inbox")).isin(*DOCUMENT_STATUS), "bad status").alias("error"),
    )
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("path", "error")


def _array_of(struct) -> str:
    return f"array<{struct.simpleString()}>"


def _from_path(place: int) -> Column:
    """Part of the path counted from the end; 1 is the file name."""
    return F.element_at(F.split("path", "/"), -place)


def read_documents(spark: SparkSession, base: str, statuses: tuple[str, ...] = DOCUMENT_STATUS, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """All documents below ``base``; a choice of statuses reads only their folders."""
    texts = read_tree(spark, base, statuses, "doc.md", bundled)
    return parse_documents(texts.where(F.col("path").rlike(rf"/({_STATUS})/[^/]+/doc\.md$")))


def read_paths(spark: SparkSession, paths: list[str], bundles: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen files, or folders of documents; with ``bundles`` those in the bundles of that folder, by their paths below it."""
    files = [p if p.endswith(".md") else f"{p.rstrip('/')}/doc.md" for p in paths]
    return parse_documents(read_texts(spark, files) if bundles is None else read_bundled_texts(spark, bundles, files))


def read_stages(spark: SparkSession, base: str, bundled: bool = False) -> DataFrame:
    """Stage files; the folders give name and counter, other than numeric folders and corrupt files are skipped."""
    texts = read_tree(spark, base, DOCUMENT_STATUS, "stage.md", bundled)
    place = r"/([^/]+)/stages/([^/]+)/([0-9]+)/stage\.md$"
    texts = texts.where(F.col("path").rlike(place))
    head, body = split_frontmatter(F.col("value"))
    parsed = texts.select("path", head.alias("head"), body.alias("body")).select("path", "body", yaml_to_json("head").alias("json"))
    v = parsed.withColumn("attrs", F.try_parse_json("json")).where("attrs IS NOT NULL")
    drop = ("name", "counter", "body", "status")
    return v.select(
        F.regexp_extract("path", place, 1).alias("doc_id"),
        F.regexp_extract("path", place, 2).alias("name"),
        F.regexp_extract("path", place, 3).cast("bigint").alias("counter"),
        F.coalesce(F.try_variant_get("attrs", "$.status", "string"), F.lit("scheduled")).alias("status"),
        F.to_variant_object(F.map_filter(F.try_variant_get("attrs", "$", "map<string,variant>"), lambda k, _: ~(k.startswith("_") | k.isin(*drop)))).alias("attrs"),
        "body",
    )


def attachments(spark: SparkSession, base: str, bundled: bool = False) -> DataFrame:
    """Files beside the documents and stages: ``(doc_id, stage, counter, filename, length)``; contents are not read."""
    if bundled:
        files = read_bundles(spark, base, DOCUMENT_STATUS).select("path", "length")
    else:
        folders = f"{base}/{{{','.join(DOCUMENT_STATUS)}}}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", "length")
    files = files.where(~F.col("path").rlike(r"/(doc|stage)\.md$"))
    at = rf"/(?:{_STATUS})/([^/]+)(?:/stages/([^/]+)/([0-9]+))?/([^/]+)$"
    part = lambda i: F.nullif(F.regexp_extract("path", at, i), F.lit(""))
    return files.select(part(1).alias("doc_id"), part(2).alias("stage"), part(3).cast("bigint").alias("counter"), part(4).alias("filename"), "length").where("doc_id IS NOT NULL")


# -- writing --------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def to_frontmatter(headers: pd.Series, bodies: pd.Series) -> pd.Series:
    """JSON header and body as frontmatter text: the body is stripped and ends with one newline."""
    import yaml

    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)

    def text(header, body):
        head = yaml.dump(json.loads(header), Dumper=dumper, sort_keys=False, allow_unicode=True).strip()
        return f"---\n{head}\n---\n{(body or '').strip()}\n"

    return pd.Series([text(h, b) for h, b in zip(headers, bodies)], dtype=object)


def document_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``(id, status, path, text)`` and ``more`` of documents (id, status, attrs, body, doc_refs, file_refs)."""
    own = F.map_filter(F.coalesce(F.try_variant_get("attrs", "$", "map<string,variant>"), F.expr("CAST(map() AS MAP<STRING, VARIANT>)")),
                       lambda k, _: ~(k.startswith("_") | k.isin("id", "status")))
    fixed = F.create_map(F.lit("id"), F.col("id").cast("variant"), F.lit("status"), F.col("status").cast("variant"))
    refs = F.create_map(*[x for name in ("doc_refs", "file_refs") for x in (F.lit(f"_{name}"), F.parse_json(F.coalesce(F.to_json(name), F.lit("[]"))))])
    header = F.to_json(F.map_concat(fixed, own, refs))
    return docs.select("id", "status", F.concat_ws("/", "status", "id", F.lit("doc.md")).alias("path"), to_frontmatter(header, "body").alias("text"), *more)


def arrow_uri(base: str) -> str:
    """A folder in the forms that Spark takes (/x, file:/x, file:///x, s3a://b/x, hdfs://h/x) as Arrow names it."""
    scheme, colon, rest = base.partition(":")
    if not colon or "/" in scheme:
        return base if base.startswith("/") else os.path.abspath(base)
    if scheme == "file":
        return "/" + rest.lstrip("/")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest


def write_files(texts: DataFrame, base: str) -> int:
    """Write ``(path, text)`` rows as files below ``base``, on the executors.

    Every file is written under a name of its own and then renamed, so a task that runs twice leaves
    the same whole file. ``base`` is a folder of any file system that Arrow knows. Returns the number of files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(arrow_uri(base))
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                target = f"{root}/{path}"
                folder, name = target.rsplit("/", 1)
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(text.encode("utf-8"))
                system.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    done = texts.select("path", "text").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]
    return done or 0


def write_bundles(texts: DataFrame, base: str) -> None:
    """Write ``(path, text)`` rows as files in bundles below ``base``, with their lengths and a folder for each top folder of the paths.

    A path that comes several times is one file, as in a tree. Later calls add files; they must not name a path again.
    """
    path = F.regexp_replace("path", "/+", "/")
    missing = F.raise_error(F.lit("a file needs a path and a text"))
    files = texts.select(F.coalesce(path, missing.cast("string")).alias("path"), F.coalesce("text", missing.cast("string")).alias("value"))
    files = files.select("path", "value", F.octet_length("value").cast("bigint").alias("length"), F.split_part("path", F.lit("/"), F.lit(1)).alias("top"))
    # one exchange and one sort: of equal paths one stays, and the rows of a top folder are together
    once = files.repartition("top", "path").dropDuplicates(["top", "path"])
    once.write.mode("append").partitionBy("top").parquet(f"{base}/{_BUNDLES}")
