"""Many small files in bundles: few files on disk, the same rows as from a tree."""

import os

from pyspark.sql import functions as F

from leafmill.plans import files
from leafmill.sources import catalogs as ca
from leafmill.sources import frontmatter as fm


def n_files(base):
    return sum(len(names) for _, _, names in os.walk(base))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def both(spark, tmp_path, texts):
    """The same files as a tree and in bundles."""
    tree, bundles = str(tmp_path / "tree"), str(tmp_path / "bundles")
    df = spark.createDataFrame(texts, "path string, text string")
    fm.write_files(df, tree)
    fm.write_bundles(df, bundles)
    return tree, bundles


STAGES = [(f"active/{d}/stages/s{n}/{c}/{name}", text) for d in range(40) for n in range(3) for c in ("1", "2", "x3")
          for name, text in (("stage.md", f"---\nstatus: done\nseq: {d}\n---\nstage {d}\n"), ("note.txt", f"ä{d}"))]


def test_stages_and_attachments(spark, tmp_path):
    """Rows that come twice and doubled slashes make no second file; later calls add files."""
    tree, bundles = both(spark, tmp_path, [*STAGES, *STAGES[:5], ("active//7/stages/s0/9/stage.md", "---\n[\n---\n"), ("other/1/stage.md", "x")])
    more = spark.createDataFrame([(f"active/{d}/about.txt", "é") for d in range(40)], "path string, text string")
    fm.write_files(more, tree)
    fm.write_bundles(more, bundles)
    stages = [fm.read_stages(spark, b, bundled=k).withColumn("attrs", F.to_json("attrs")) for b, k in ((tree, False), (bundles, True))]
    assert rows(stages[1]) == rows(stages[0]) and stages[1].count() == 240
    found = [[tuple("" if v is None else str(v) for v in r) for r in fm.attachments(spark, b, bundled=k).collect()] for b, k in ((tree, False), (bundles, True))]
    assert sorted(found[1]) == sorted(found[0]) and ("5", "", "", "about.txt", "2") in found[1]
    assert n_files(bundles) < 60 < n_files(tree)


def test_a_query_of_stages_writes_few_files(spark, tmp_path, monkeypatch):
    """Before, every stage was a file in folders of its own."""
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    events = spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 50 AS user_id", "'view' AS event_type", "100.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert files.stage_scan(spark, str(tmp_path)).count() == 3000
    assert n_files(tmp_path / "stages") < 300
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(tmp_path / "more" / purpose))
    assert files.attachment_manifest(spark, str(tmp_path)).count() == 3050
    assert n_files(tmp_path / "more") < 300


def test_catalogs(spark, tmp_path):
    texts = [(f"stages/p{i}.yml", f"name: p{i}\n") for i in range(9)] + [("stages/deep/q.yml", "name: q\n"), ("stages/p.yaml", "name: r\n")]
    texts += [(f"workflows/p{i}/wf.json", f'{{"name": "w{i}"}}') for i in range(9)] + [("workflows/event_handlers.json", "{}"), ("workflows/p1/event_handlers.json", '{"name": "e"}'), ("workflows/p1/x.js", "{}")]
    tree, bundles = both(spark, tmp_path, texts)
    for read in (ca.read_definitions, lambda *a, **k: ca.read_workflows(*a, "o", **k)):
        assert rows(read(spark, bundles, bundled=True).select("name")) == rows(read(spark, tree).select("name"))


def test_a_query_of_catalogs_writes_few_files(spark, tmp_path, monkeypatch):
    """Before, every part was three files."""
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    spark.range(500).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "'ECONOMY' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    assert files.workflow_catalog(spark, str(tmp_path)).count() == 490
    assert n_files(tmp_path / "catalog") < 60


def test_documents(spark, tmp_path):
    texts = [(f"{s}/{i}/doc.md", f"---\nid: {i}\nstatus: {s}\n---\nbody {i}\n") for s in ("inbox", "done") for i in range(5)]
    texts += [("done/9/doc.md", "---\nx: [1\n---\n"), ("done/9/plan.md", "x"), ("done/doc.md", "lost")]
    tree, bundles = both(spark, tmp_path, texts)
    for statuses in (("done",), ("inbox", "done", "blocked")):
        pairs = [fm.read_documents(spark, b, tuple(s for s in statuses if k or s != "blocked"), **({"bundled": True} if k else {})) for b, k in ((tree, 0), (bundles, 1))]
        assert rows(pairs[1][0].select("id", "status", "folder_status", "body")) == rows(pairs[0][0].select("id", "status", "folder_status", "body"))
        assert pairs[1][1].count() == pairs[0][1].count() == 1
    assert rows(fm.read_paths(spark, ["done/*"], bundles=bundles)[0].select("id")) == rows(fm.read_paths(spark, [f"{tree}/done/*"])[0].select("id"))


def test_a_query_of_documents_writes_few_files(spark, tmp_path, monkeypatch):
    """Before, every document was a file in a folder of its own."""
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('title ', id) AS text", "'en' AS lang", "'web' AS source", "9L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(0).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    assert files.frontmatter_roundtrip(spark, str(tmp_path)).count() == 400
    assert n_files(tmp_path / "documents") < 100


def test_nothing_to_write(spark, tmp_path):
    fm.write_bundles(spark.createDataFrame([], "path string, text string"), str(tmp_path))
    assert fm.read_stages(spark, str(tmp_path), bundled=True).count() == 0
