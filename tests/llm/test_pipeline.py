"""The pipeline against plain Python, stage by stage and as a whole."""

import re

import brute
import sentencepiece

import corpus_pipeline
from test_models import labelled, plain_mix
from wayfold.llm import mixing, quality, sentencepieces


def test_run_equals_the_stages_in_plain_python(spark, tmp_path):
    data = labelled(240, 8)
    docs = [(i, t, ["en", "fr", "de"][i % 3], f"s{i % 4}", len(t)) for i, t, _ in data]
    docs += [(1000 + i, t.replace(" ", "\t"), lang, s, n) for i, t, lang, s, n in docs[:40]]
    docs += [(2000 + i, t + " and", lang, s, n) for i, t, lang, s, n in docs[50:60]]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "source_mixing", "sentencepiece"]

    good = {r.doc_id for r in quality.classified(df, labels).collect() if r.predicted}
    rows = [d for d in docs if d[0] in good]
    keep = {i for i, k, *_ in brute.exact_rows([d[:2] for d in rows]) if i == k}
    rows = [d for d in rows if d[0] in keep]
    keep = {i for i, _, c in brute.simhash_rows([d[:2] for d in rows]) if i == c}
    rows = [d for d in rows if d[0] in keep]
    mixed = plain_mix([d[:4] for d in rows], mixing.BUDGET_PERCENT, mixing.MAX_EPOCHS, mixing.SEED, mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})
    text = {d[0]: d[1] for d in rows}
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.model_bytes())
    want = sorted((i, tuple(sp.encode(text[i]))) for i, _, _ in mixed)

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(names) - {"text"} <= set(out.columns)
    assert sorted((r.doc_id, tuple(r.ids)) for r in out.collect()) == want

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == names


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, mix_lang string, component_id int"


def test_run_on_awkward_rows(spark, tmp_path, monkeypatch):
    """Null ids, texts, languages; repeated rows, one id for two texts, a text above a mebibyte, clashing names."""
    data = labelled(300, 8)
    good = [t for _, t, q in data if q]
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in data]
    rows += [(None, good[0], "en", "s", 1), (None, good[1] + " more of it", None, None, 1), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, good[2] + " " + "long words here. " * 80_000, "fr", "t", 5)]
    rows += [(data[1][0], "quite another text of its own. " + good[3], "en", "s", 2), rows[1], rows[1]]
    df = spark.createDataFrame([(*r, "key", "mine", 7) for r in rows], COLUMNS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(mixing, "BUDGET_PERCENT", 100)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    unique = stage["exact_dedup"](spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    got = [(r.doc_id, r.text) for r in unique.collect()]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in got]
    assert len(set(texts)) == len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})
    near = stage["simhash"](spark, unique, str(tmp_path))
    assert near.columns == docs.columns and len(near.collect()) == len(set(brute.simhash_groups([(i, t) for i, t in got if len(t or "") < 100_000]))) + 1
    mix = stage["source_mixing"](spark, near, str(tmp_path))
    assert mix.schema == docs.schema and {r.mix_lang for r in mix.collect()} == {"mine"}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(r.doc_id, tuple(r.ids)) for r in out}) > 100 and all(r.row_key == "key" and r.component_id == 7 for r in out)
    assert max(r.n_tokens for r in out) > 200_000 or 902 not in {r.doc_id for r in out}


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "lang", "n_tokens", "ids"} <= set(out.columns)


def test_checkpoints_need_a_shared_folder_off_local_mode(spark):
    import types

    import pytest

    from wayfold.llm import _tables

    def context(master, folder=None, conf=None):
        told = []
        sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: folder, getConf=lambda: types.SimpleNamespace(get=lambda k: conf), setCheckpointDir=told.append)
        return types.SimpleNamespace(sparkContext=sc), told

    session, told = context("yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _tables.checkpoints(session)
    session, told = context("spark://host:7077", conf="hdfs://shared")
    _tables.checkpoints(session)
    assert told == ["hdfs://shared"]
    session, told = context("local-cluster[2,1,1024]", folder="hdfs://set")
    _tables.checkpoints(session)
    assert told == []
    session, told = context("local[4]")
    _tables.checkpoints(session)
    assert len(told) == 1 and "wayfold-checkpoints-" in told[0]
