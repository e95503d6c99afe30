"""Quality, mixing, SentencePiece, secrets, neighbours and HTML, on awkward and labelled inputs."""

import random

import numpy as np
import pytest
import sentencepiece

import brute
from wayfold.llm import html_extract, mixing, neighbours, quality, secrets_scan, sentencepieces

TEXTS = [None, "", " ", "   ", "a", "Hello  world\n\tfoo   ", "\x00", "▁x▁▁ y", "<s> <unk> <0x41>", "ﷺ 😀 語", "x" * 3000, "word " * 4000]


def test_encoding_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.model_bytes())
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice(" abcdefghijklmnop  \n.é語😀") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    got = {r.doc_id: r for r in sentencepieces.encoded(docs).collect()}
    real = {r.doc_id: r for r in sentencepieces.with_ids(docs).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids)))
        assert real[i].ids == ids and real[i].n_tokens == len(ids)
    assert sentencepieces.encoded(docs.limit(0)).collect() == []


def test_encoding_with_a_tiny_cache(monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT", 4)
    monkeypatch.setattr(sentencepieces, "PAIRS", 3)
    model = sentencepieces.model_bytes()
    sp, mine = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.Codec(model)
    for text in ["the quick brown fox jumps over the lazy dog " * 3, "a b c d e f g a b c ▁ d"]:
        assert mine.encode(text) == (",".join(map(str, sp.encode(text))), sp.decode(sp.encode(text)))


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioudhlnrst") for _ in range(rng.randint(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(rng.randint(4, 12))).capitalize() for _ in range(rng.randint(2, 8))) + "."
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: " | ".join(word() for _ in range(40)), lambda: (word() + " ") * 50, lambda: " ".join(word() + rng.choice(["###", "&&&", "$$$"]) for _ in range(40))]
    return [(i, good() if i % 3 else rng.choice(bad)(), int(i % 3 > 0)) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    data = labelled(900, 3)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in data] + [(None, "no id", "en", 0.5), (5000, None, None, None), (5001, "", None, None), (5001, "", None, None)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classified(docs, labels).collect()
    assert len(out) == len(data) + 4
    truth = {i: q for i, _, q in data}
    import zlib

    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)


def test_quality_query_equals_plain_python(spark, tmp_path):
    """The whole query, labels and all, against features, updates and scores made number by number."""
    import math
    import zlib

    from wayfold.llm import _text

    data = labelled(160, 5) + [(500, None, 1), (501, "", 0), (502, "A a a 1x!! é", 1), (503, "  \t\n", 0)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in data] + [(None, "no id", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    feats = {i: brute.quality_features(t, [int(x) for x in _text._TABLE], _text.BASE, [int(x) for x in quality._SALT], quality.BITS) for i, t, _ in data}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in data}
    examples = [(feats[i], q) for i, _, q in sorted(data, key=lambda d: d[0]) if i % 5 and not held[i]]
    passes = min(quality.EPOCHS[1], max(quality.EPOCHS[0], -(-quality.UPDATES // len(examples))))
    weight = brute.quality_model(examples, passes, quality.SEED, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    got = {r.doc_id: r for r in quality.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(data) + 1
    for i, _, _ in data:
        dot = sum(weight.get(s, 0.0) * v for s, v in feats[i].items()) + 0.1 * weight[None]
        assert abs(got[i].score - 1 / (1 + math.exp(-dot))) < 1e-4 and got[i].held_out == held[i]
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_quality_training_is_bounded(spark, monkeypatch):
    """One text of an id that is repeated, and texts until they make TRAIN_BYTES."""
    docs = spark.createDataFrame([(1, f"copy {k} " + "long " * 50_000) for k in range(40)] + [(i, "some words " * 9) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "TRAIN_BYTES", 2000)
    seen = []
    monkeypatch.setattr(quality, "_train_rows", lambda rows: __import__("pyarrow").table({"weights": [rows.num_rows.to_bytes(4, "little") * (1 << quality.BITS)], "bias": [0.0]}))
    weights, _ = quality.model(docs, labels)
    seen = int(weights.view(np.int32)[0])
    assert 1 <= seen <= 2000 // 99 + 2


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classified(docs, labels).collect()] == [0.5]
    assert quality.classified(docs.limit(0), labels).collect() == []


def plain_mix(docs, percent, epochs, seed, dw, lw, sw):
    """Mixing in plain Python: (doc_id, epoch, before) of each chosen row."""
    import hashlib
    import math
    from collections import defaultdict

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    domain = lambda s: mixing.DOMAINS[0 if int(md5(s)[0], 16) < 6 else 1 if int(md5(s)[0], 16) < 11 else 2]
    leaves = defaultdict(list)
    for i, t, lang, src in docs:
        leaves[(domain(src or ""), lang or "", src or "")].append((i, len(brute.WORD.findall(t or ""))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def share(budget, kids):  # kids: name -> (cap, weight)
        out, left = {}, dict(kids)
        while left:
            w = sum(x for _, x in left.values())
            full = [k for k, (c, x) in left.items() if c * w <= x * budget]
            if not full:
                return out | {k: math.floor(budget * x / w) for k, (_, x) in left.items()}
            for k in full:
                out[k] = left.pop(k)[0]
                budget -= out[k]
        return out

    cap = lambda p: sum(s for k, s in supply.items() if k[: len(p)] == p) * epochs
    got = {}
    for d, b in share(sum(supply.values()) * percent // 100, {k[0]: (cap(k[:1]), dw.get(k[0], 1)) for k in supply}).items():
        for lang, b2 in share(b, {k[1]: (cap(k[:2]), lw.get(k[1], 1)) for k in supply if k[0] == d}).items():
            for s, b3 in share(b2, {k[2]: (cap(k), sw.get(k[2], 1)) for k in supply if k[:2] == (d, lang)}).items():
                got[(d, lang, s)] = b3
    rows = []
    for leaf, members in leaves.items():
        whole = got[leaf] // supply[leaf] if supply[leaf] else epochs
        rest = got[leaf] - whole * supply[leaf]
        for e in range(min(whole, epochs - 1) + 1):
            units = defaultdict(int)
            for i, n in members:
                units[i] += n
            run = 0
            for i in sorted(units, key=lambda i: (md5(f"{seed}|{e}|{'' if i is None else i}"), i is None, i or 0)):
                if e < whole or run + units[i] <= rest:
                    rows += [(i, e, run)] * sum(1 for j, _ in members if j == i)
                run += units[i]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("percent,epochs", [(60, 2), (150, 3), (10, 1), (100, 1), (400, 2)])
def test_mixing(spark, percent, epochs):
    rng = random.Random(percent)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["en", "en", "en", "fr", "de", None]), rng.choice(["s1"] * 9 + ["s2", "s3", "s4", None])) for i in range(300)]
    docs += [(7, "again and again", "en", "s1"), (7, "again and again", "en", "s1"), (None, "no id", "en", "s1"), (301, None, "en", "s2")]
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, lang string, source string, salt string")
    got = sorted(((r.doc_id, r.mix_epoch, r.mix_before) for r in mixing.mix(df, percent=percent, epochs=epochs).collect()), key=repr)
    assert got == plain_mix(docs, percent, epochs, mixing.SEED, mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_returns_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, "some words", "en", f"s{i}", "mine", i, 0.5, "x", "y") for i in range(30)], "doc_id long, text string, lang string, source string, mix_lang string, mix_tokens int, Mix_Before double, doc_id_of string, own_mix_lang string")
    out = mixing.mixed(docs, percent=200)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(tuple(r) for r in out.collect()) == sorted([tuple(r) for r in docs.collect()] * 2)


def test_mixing_of_many_sources_in_one_family(spark):
    """Sources whose shares fill up one after another, ties among them."""
    rng = random.Random(3)
    docs = [(i, "w " * (rng.choice([1, 1, 1, 2, 5]) if i % 3 else rng.randint(1, 400)), "en", f"host{i % 150}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    weights = {f"host{i}": rng.choice([1, 2, 7, 50]) for i in range(0, 150, 2)}
    for percent, epochs in ((40, 1), (90, 1), (150, 2)):
        got = sorted(((r.doc_id, r.mix_epoch, r.mix_before) for r in mixing.mix(df, percent=percent, epochs=epochs, source_weights=weights).collect()), key=repr)
        assert got == plain_mix(docs, percent, epochs, mixing.SEED, mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, weights)


def exact_neighbours(rows, q, k, measure):
    """(vec_id, score) of the k nearest, from rows of (vec_id, vector)."""
    own = next(v for i, v in rows if i == q)
    score = [(i, float(np.dot(v, own)) if measure == "product" else -float(((v - own) ** 2).sum())) for i, v in rows if i != q]
    return sorted(score, key=lambda s: (-s[1], s[0]))[:k]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours(spark, monkeypatch, kind):
    """Blocks of 300 of which 40 are scored exactly, and cells of about 250 rows of which some are visited."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32 if kind == "float" else np.float64)
    x[100:400] = x[100]  # many copies of one vector
    if kind == "double":
        x[7] *= 1e39  # finite, and beyond float
    bad = [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [1.0] * 15 + [None]), (9080, [1.0] * 15 + [float("nan")]), (9100, [1.0] * 15 + [float("inf")]), (None, [1.0] * 16), (9120, [1.0] * 3)]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 2) for i, v in bad] + [(20, x[20].tolist(), 1)]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, cell int")
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 250)
    rows = [(i, v.astype(float)) for i, v in enumerate(x)] + [(20, x[20].astype(float))]
    for measure in ("product", "distance"):
        by = {}
        for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 20, measure, rerank=40).collect():
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(by) == set(range(0, 3000, 20))
        hit = 0
        for q in list(by)[::3]:
            want = exact_neighbours(rows, q, 20, measure)
            found = sorted(by[q])
            assert [a for a, _, _ in found] == list(range(1, 21))
            assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
            exact = {i: s for i, s in exact_neighbours(rows, q, 4000, measure)}
            assert all(np.isclose(s, exact[i], rtol=1e-12) for _, i, s in found)
            hit += sum(s >= want[-1][1] - 1e-12 * abs(want[-1][1]) for _, _, s in found)
        assert hit / (20 * len(list(by)[::3])) >= 0.9
    everything = neighbours.search(df, df.where("vec_id = 40"), 20, rerank=4000, cells=1).orderBy("rank").collect()
    assert [r.vec_id for r in everything] == [i for i, _ in exact_neighbours(rows, 40, 20, "product")]
    few = df.where("vec_id < 5")
    assert [r.vec_id for r in neighbours.search(few, few.where("vec_id = 0"), 20).orderBy("rank").collect()] == [i for i, _ in exact_neighbours(rows[:5], 0, 20, "product")]
    assert neighbours.search(df.limit(0), df.limit(0), 20).collect() == []


def test_cells_are_visited_until_recall_holds():
    rng = np.random.default_rng(4)
    loose = rng.normal(size=(2000, 24)).astype(np.float32)
    tight = (20 * rng.normal(size=(16, 24))[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 24))).astype(np.float32)
    for x, low, high in ((loose, 8, 16), (tight, 1, 4)):
        centres = neighbours._kmeans(x, 16, np.random.default_rng(1))
        probes = neighbours.cells_to_visit(x, centres, 20, "distance")
        assert low <= probes <= high


def test_secrets(spark):
    fresh = secrets_scan.labelled_findings(800, seed=99)
    forest = secrets_scan.default_forest()
    share = forest.share(np.array([secrets_scan.describe(*f[:3]) for f in fresh]))
    assert np.mean((share >= 0.5) == np.array([f[3] for f in fresh])) > 0.97
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.createDataFrame(
        [(1, f'see token = "{key}" and again token = "{key}"', 3), (2, None, 3), (3, "", 3), (4, f"commit {key} fixes it", 3), (5, "plain words " * 9000 + f'password: "{key}"', 3), (6, f'token = "{key}"', 3), (6, f'token = "{key}"', 3), (None, "x", 3)],
        "doc_id long, text string, size int",
    )
    out = sorted((r.doc_id, r.at, r.key_sha256) for r in secrets_scan.findings(docs).collect())
    sha = brute.sha(key)
    assert out == [(1, 13, sha), (1, 13 + len(key) + len("\" and again token = \""), sha), (5, 9000 * 12 + 11, sha), (6, 9, sha), (6, 9, sha)]
    assert secrets_scan.findings(docs.limit(0)).collect() == []


PAGES = {
    None: "",
    "": "",
    "just words": "just words",
    "<html><body><nav><ul><li><a href=/>home</a></li><li><a href=/b>more</a></li></ul></nav><article><h1>Big title here</h1><p>First &amp; &eacute; part<br>of it, with some <b>bo</b>ld words in it.<p>Second   part\n of the long text, unclosed</article><div class=comments><p>nice one, thanks</p></div><footer>&copy; me</footer></body></html>": "Big title here First & é part of it, with some bold words in it. Second part of the long text, unclosed",
    '<body><script>var t="</p><p>no";</script><article><p>Some words of the article stand here, as in any page.</p><script>x</script><!-- gone <p> --><p>And others stand in this one, a > b.</p></article><aside class="sidebar"><ul><li><a href=x>a</a></ul></aside>': "Some words of the article stand here, as in any page. And others stand in this one, a > b.",
    "<body><article><h2>Cut off</h2><p>The page ends in the middle of a tag, which is dropped &am<a hre": "Cut off The page ends in the middle of a tag, which is dropped &am",
}


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(PAGES)] + [(None, None, "<p>x", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extracted(pages).collect()}
    for i, (page, text) in enumerate(PAGES.items()):
        assert (got[i].text, got[i].n_chars) == (text, len(text)), page
    assert html_extract.extracted(pages.limit(0)).collect() == []


def test_marginals_equal_enumeration():
    import itertools
    import math

    rng = random.Random(1)
    up = [-1, 0, 0, 1, 1, 2]
    field = [rng.uniform(-2, 2) for _ in up]
    edge = tuple(rng.uniform(-1, 1) for _ in range(4))
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        weight[y] = math.exp(sum(f * s for f, s in zip(field, y)) + sum(edge[2 * y[up[i]] + y[i]] for i in range(1, 6)))
    z = sum(weight.values())
    post, pairs = html_extract.marginals(field, up, edge)
    for i in range(6):
        assert abs(post[i] - sum(w for y, w in weight.items() if y[i]) / z) < 1e-9
    for i, *p in pairs:
        for s in range(4):
            assert abs(p[s] - sum(w for y, w in weight.items() if 2 * y[up[i]] + y[i] == s) / z) < 1e-9


def test_html_model_on_held_out_pages():
    model = html_extract.default_model()
    right = wrong = 0
    for page, mark in html_extract.labelled_pages(80, seed=77):
        nodes, _ = html_extract.parse(page)
        want = [mark in n.names.split() for n in nodes]
        for n in nodes:
            n.names = " ".join(w for w in n.names.split() if w != mark)
        for n, y, p in zip(nodes, want, model.content(nodes)):
            if n.own:
                right += (p >= 0.5) == y
                wrong += (p >= 0.5) != y
    assert right / (right + wrong) > 0.97
