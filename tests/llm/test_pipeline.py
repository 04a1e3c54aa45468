"""The pipeline's stages on planted cases, and its registration."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = "harbor lantern meadow copper violet timber anchor barley candle drifter ember falcon granite hollow island jasper kettle ladder mantle nectar orchard pebble quarry ribbon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 30)) for i in range(3)]
    line = "this line stands in a great many of these documents, without any need"
    rows = [(i, prose(rng, 80) + ("\n" + line if 10 <= i < 20 else "") + "\n" + prose(rng, 5)) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[4][1].replace(" ", "  ")), (62, rows[5][1] + " more")]
    rows += [(70, prose(rng, 20) + " " + items[1][1] + " " + prose(rng, 20)), (80, prose(rng, 30) + ". you are a stupid idiot, worthless scum. " + prose(rng, 9)), (90, ""), (91, None), (None, prose(rng, 60)), (95, "twice the very same row, kept once"), (95, "twice the very same row, kept once"), (95, "another text of that id, kept too")]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxic_score string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 80)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline

    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        left[name] = docs.collect()
        docs = spark.createDataFrame(left[name], docs.schema)
        if name != "source_mix":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in rows} for name, rows in left.items()}
    assert set(before) - ids["toxicity"] == {80}
    lines = {r.doc_id: r.text for r in left["line_dedup"]}
    assert ids["line_dedup"] == ids["toxicity"] and [i for i in lines if "great many" in (lines[i] or "")] == [19]
    assert all(r.n_chars == len(r.text) for r in left["line_dedup"])
    assert ids["line_dedup"] - ids["near_dedup"] == {60, 61, 62}
    assert sorted(r.text for r in left["near_dedup"] if r.doc_id == 95) == ["another text of that id, kept too", "twice the very same row, kept once"]
    assert ids["near_dedup"] - ids["decontamination"] == {70}
    assert {r.doc_id for r in left["source_mix"]} <= ids["decontamination"]
    mixed = left["source_mix"]
    assert all(r.copy_no <= r.n_copies for r in mixed)
    assert sum(len(r.text) for r in mixed) == pytest.approx(sum(len(r.text) for r in left["decontamination"]), rel=0.5)


def test_run_is_the_stages(spark, folder):
    import __spark_entry__
    import corpus_pipeline

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "copy_no", "shuffle_key"} <= set(out.columns) and out.filter(F.col("doc_id").isin(60, 61, 62, 70, 80)).isEmpty()


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_writes_few_files(spark, tmp_path, monkeypatch):
    """Each file makes an executor start processes, so small tables must not have a file for every shuffle partition."""
    from ledgerfold.llm import components, superminhash

    files, store = {}, superminhash.store

    def counted(df, name, *args):
        out, path = store(df, name, *args)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out, path

    for module in (superminhash, components):
        monkeypatch.setattr(module, "store", counted)
    set_ = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in set_}
    for key, value in set_.items():
        spark.conf.set(key, value)
    try:
        rng, rows = random.Random(3), []
        for i in range(60):
            text = prose(rng, 120)
            rows += [(2 * i, text), (2 * i + 1, text + " " + prose(rng, 6))]
        out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert all(r.component_id == r.doc_id // 2 * 2 for r in out)
    assert all(max(files[name]) == 1 for name in ("links", "labels", "near-wanted", "near-pairs", "near-links", "near-groups", "near-apart"))
