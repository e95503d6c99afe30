"""Exact, substring, suffix and SimHash dedup against plain Python, on awkward tables."""

import random
import re

import brute
import numpy as np
import pytest
import xxhash

from wayfold.llm import _text, exact_dedup, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, part int, fp string, row string, kept string"


def awkward():
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("alpha beta Gamma delta é ß 語 x".split()) + str(rng.randint(0, 99)) for _ in range(n))
    shared = words(60)
    docs = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "Two words"), (6, "one"), (None, words(30)), (7, shared), (8, shared), (8, shared)]
    docs += [(9, words(9) + " " + shared + " " + words(5)), (10, shared.replace(" ", "\t \n")), (11, words(4000)), (12, "x" * 5000), (13, "x" * 5000 + "y")]
    docs += [(14, words(20) + " " + words(20)), (15, shared[:-1] + "é"), (None, shared), (16, "a\x00b " * 30), (17, words(2))]
    docs += [(100 + k, shared + " tail" + str(k)) for k in range(40)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


TABLES = {"awkward": awkward(), "empty": [], "one": [(5, "only one")], "nulls": [(None, None), (None, None)]}


@pytest.mark.parametrize("name", TABLES)
def test_exact(spark, name):
    got = rows(exact_dedup.exact_groups(frame(spark, TABLES[name])), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact_rows(TABLES[name])


def rearranged():
    """Passages whose windows a source has in other order, repeats, and chains of copies; rows of one id."""
    rng = random.Random(12)
    words = lambda n: [rng.choice("ab cd ef gh ij kl".split()) for _ in range(n)]
    base, line = words(80), words(9)
    docs = [(5, " ".join(base)), (9, " ".join(base[40:] + base[:40])), (9, " ".join(base[10:70])), (None, " ".join(base[5:50])), (None, " ".join(base[5:50]))]
    docs += [(20 + k, " ".join(line * k)) for k in range(1, 9)] + [(3, " ".join(line * 3 + base[:30] + line * 5))]
    docs += [(40 + k, " ".join(words(3) + base[k * 5 : k * 5 + 30] + words(2) + base[60 - k * 3 :] + words(1))) for k in range(9)]
    docs += [(60, " ".join(base[i // 2 % 80] for i in range(300))), (61, " \t".join(base[i // 2 % 80] for i in range(100, 290)))]
    return docs


@pytest.mark.parametrize("name", [*TABLES, "rearranged", "periodic"])
def test_substring(spark, name, monkeypatch):
    data = {"rearranged": rearranged, "periodic": periodic}.get(name, lambda: TABLES[name])()
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 300)
    got = rows(substring_dedup.digests(frame(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_rows(data)


@pytest.mark.parametrize("name", ["awkward", "rearranged"])
def test_factors_have_their_words_in_the_source(spark, name, monkeypatch):
    data = rearranged() if name == "rearranged" else TABLES[name]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    found = substring_dedup.spans(frame(spark, data)).collect()
    texts = [(i, brute.WORD.findall(t or "")) for i, t in data]
    assert found and max(r.n_words for r in found) > 13
    for r in found:
        assert r.source_id is not None and (r.doc_id is None or r.source_id < r.doc_id)
        here = {tuple(w[r.start : r.start + r.n_words]) for i, w in texts if i == r.doc_id}
        there = {tuple(w[r.source_start : r.source_start + r.n_words]) for i, w in texts if i == r.source_id}
        assert any(len(w) == r.n_words for w in here & there)


def test_substring_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With window hashes of eight bits the words decide: nothing goes that the source doesn't have."""
    run_hash = _text.run_hash
    monkeypatch.setattr(substring_dedup, "_windows", lambda *a, f=substring_dedup._windows: (lambda h, w, r: (h & np.uint64(0xFF << 56), w, r))(*f(*a)))
    data = rearranged()
    b = substring_dedup._Block(_parts_table(data), 13)
    begin, many, source, rank = b.factors(_NO_ANSWERS)
    assert len(np.unique(b.hashes)) < 257 and len(begin) and run_hash
    claims = substring_dedup._factored(13)(_parts_table(data), _NO_ANSWERS)
    out = substring_dedup._verify(13)(_parts_table(data), claims.select(list(substring_dedup._KEYS)))
    at = out.column("at").to_pylist()
    assert -1 in at
    lists = [brute.WORD.findall(t or "") for _, t in sorted(data, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))]
    for k, place in enumerate(at):
        w0 = int(b.word[begin[k]])
        row = int(b.row[begin[k]])
        words = lists[row][w0 - int(b.first[row]) :][: int(many[k]) + 12]
        if place >= 0:
            assert any(lists[r][place : place + len(words)] == words for r in np.flatnonzero(b.ranks()[1] == rank[k]))


def _parts_table(data):
    import pyarrow as pa

    return pa.table({"part": pa.array([0] * len(data), pa.int32()), "doc_id": pa.array([i for i, _ in data], pa.int64()), "text": pa.array([t for _, t in data], pa.string())})


def _no_answers():
    import pyarrow as pa

    kinds = {"part": pa.int32(), "bucket": pa.int32(), "n": pa.int32(), "seen": pa.binary(), "source": pa.binary(), "rank": pa.binary()}
    return pa.schema(list(kinds.items())).empty_table()


_NO_ANSWERS = _no_answers()


def periodic():
    """Runs of one letter, of short and of long lines, cut and joined in ways that part windows from their anchors."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    tail, head = noise(600), noise(600)
    line = noise(60)
    docs = [(1, "x" * 1000 + tail), (2, "x" * 350 + tail), (3, head + "x" * 399 + tail), (4, "x" * 400), (5, "x" * 401), (6, "y" * 399), (7, "y" * 400), (8, head + "x" * 5000)]
    for k, size in enumerate((2, 3, 7, 10, 11, 24, 25, 26, 49, 50, 51)):
        unit = noise(size)
        for j, n in enumerate((399, 400, 401, 400 + size - 1, 400 + size, 520, 1500)):
            cut = rng.randrange(size)
            docs.append((100 + 10 * k + j, rng.choice([head[-j * 9 :], ""]) + (unit * (n // size + 2))[cut : cut + n] + rng.choice([tail[: j * 99], noise(30), ""])))
    docs += [(300 + k, line * k + noise(40) + line * 9) for k in range(1, 12)] + [(330, line * 90)]
    docs += [(340 + k, "".join(rng.choice(["ab" * rng.randint(1, 40), "a" * rng.randint(1, 70), "c"]) for _ in range(60))) for k in range(8)]
    return docs


SUFFIX_TABLES = TABLES | {"periodic": periodic()}


@pytest.mark.parametrize("name", SUFFIX_TABLES)
@pytest.mark.parametrize("length,gram,hot", [(400, 100, 64), (50, 20, 64), (50, 20, 1)])
def test_suffix(spark, name, length, gram, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_CORES", 500)
    monkeypatch.setattr(suffix_dedup, "BUCKET_CONTEXTS", 300)
    monkeypatch.setattr(suffix_dedup, "LOT_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "STRETCH_BYTES", 1700)
    docs = SUFFIX_TABLES[name]
    got = rows(suffix_dedup.digests(frame(spark, docs), length=length, gram=gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_rows(docs, length)


def test_suffix_core_hashes_only_rule_out(spark, monkeypatch):
    """With hashes of few values, strings that differ meet in one core and still don't count as equal."""
    docs = periodic()[:60]
    mix = _text.mix
    monkeypatch.setattr(_text, "mix", lambda h: mix(h) & np.uint64(0xFF00000000000000))
    data = [t.encode() for _, t in docs]
    off = np.cumsum([0, *map(len, data)])
    hashes, places, _ = suffix_dedup._cores(np.frombuffer(b"".join(data), np.uint8), off, 50, 20)
    assert len(np.unique(hashes)) < len(places) / 4
    whole = b"".join(data)
    contexts = sorted({whole[p - 15 : p + 50] for p in places.tolist() if 15 <= p <= len(whole) - 50})
    room = np.full((len(contexts), 2), 15)
    least, most = suffix_dedup.reaches(np.frombuffer(b"".join(contexts), np.uint8).reshape(-1, 65), room, 15)
    for i in range(0, len(contexts), 7):
        want = [o for o in range(16) if any(j != i and c[15 - o : 65 - o] == contexts[i][15 - o : 65 - o] for j, c in enumerate(contexts))]
        assert (least[i], most[i]) == ((want[0], want[-1]) if want else (-1, -1))


def test_suffix_run_of_one_letter_is_a_few_cores():
    text = np.full(1_000_000, 120, np.uint8)
    with np.errstate(over="ignore"):
        hashes, _, runs = suffix_dedup._cores(text, np.array([0, len(text)]), 400, 100)
        line = np.tile(np.frombuffer(b"a line that is repeated again and again, sixty bytes of it..", np.uint8), 3000)
        many, _, none = suffix_dedup._cores(line, np.array([0, len(line)]), 400, 100)
    assert len(hashes) < 10 and runs.tolist() == [[0, 1_000_000]]
    assert len(many) < 2 * len(line) / 60 + 20 and not len(none)


def test_suffix_document_above_eight_mebibytes(spark):
    rng = np.random.default_rng(6)
    body = "".join(map(chr, rng.integers(97, 123, 9_000_000)))
    shared = body[8_388_300:8_388_900]  # lies across the end of the first stretch
    docs = [(1, body), (2, "first " + shared + " last"), (3, "z" * 9_000_000 + "end")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(frame(spark, docs)).collect()}
    assert got == {1: (9_000_000, 600, 1), 2: (611, 600, 1), 3: (9_000_003, 9_000_000, 1)}


def test_columns_number_sorted_suffixes():
    rng = np.random.default_rng(0)
    texts = rng.integers(0, 3, (200, 12), dtype=np.uint8)
    start = rng.integers(0, 4, 200)
    for o, classes in enumerate(suffix_dedup.columns(texts, start)):
        keys = [(texts[i, 12 - o :].tobytes(), start[i]) for i in range(200)]
        ranks = {k: r for r, k in enumerate(sorted(set(keys)))}
        assert [ranks[k] for k in keys] == classes.tolist()


@pytest.mark.parametrize("name", TABLES)
def test_simhash(spark, name):
    got = rows(simhash.near_groups(frame(spark, TABLES[name])), "doc_id", "fingerprint", "component_id")
    assert got == brute.simhash_rows(TABLES[name])


def test_simhash_meetings_find_every_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        now = int(b)
        for _ in range(60):  # chains of fingerprints, two or three bits apart
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                now ^= 1 << int(bit)
            fps.append(now)
    fps = np.array(sorted(set(fps)), np.uint64)
    for direct in (4, 10_000):
        simhash.DIRECT, old = direct, simhash.DIRECT
        forest = simhash._Forest(len(fps))
        simhash._meet(fps, np.arange(len(fps)), list(range(64)), forest)
        simhash.DIRECT = old
        want = simhash._Forest(len(fps))
        for a in range(len(fps)):
            for b in np.flatnonzero(simhash._popcount(fps ^ fps[a]) <= 3):
                want.link(a, int(b))
        assert [forest.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2800, 500)
    end = start + rng.integers(0, 200, 500)
    with np.errstate(over="ignore"):
        got = simhash.xxh64(data, start, end)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert _text.unpack_sorted(_text.pack_sorted(values)).tolist() == values.tolist()


def stays(groups, docs):
    """(id, text) of the row that stays of each group: smallest id, null last; one only."""
    out = []
    for g in set(groups):
        ids = [i for (i, _), h in zip(docs, groups) if h == g and i is not None]
        out.append(min(ids) if ids else None)
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", TABLES)
def test_kept_documents(spark, name):
    data = TABLES[name]
    docs = frame(spark, data)
    kept, near = exact_dedup.keep_one(docs), simhash.keep_one(docs)
    assert kept.columns == near.columns == docs.columns
    exact = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in data]
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert set(got) <= set(data) and sorted(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in got) == sorted(set(exact))
    assert sorted((i for i, _ in got), key=repr) == stays(exact, data)
    got = [tuple(r) for r in near.select("doc_id", "text").collect()]
    assert set(got) <= set(data)
    assert sorted((i for i, _ in got), key=repr) == stays(brute.simhash_groups(data), data)


@pytest.mark.parametrize("keep", [exact_dedup.keep_one, simhash.keep_one])
def test_rows_go_by_row_and_not_by_id(spark, keep):
    b, a, c = "one two three four five six", "quite another text that stands here alone", "neither of these two, but a third one"
    docs = [(3, b), (5, a), (5, b), (8, b), (8, b), (None, c), (None, c), (None, b), (9, a.replace(" ", "  ")), (5, a), (5, a)]
    got = sorted(((r.doc_id, r.text) for r in keep(frame(spark, docs)).collect()), key=repr)
    assert got == sorted([(3, b), (5, a), (None, c)], key=repr)


def test_rows_of_one_id_and_text_that_differ_otherwise(spark):
    docs = spark.createDataFrame([(1, "same", k, "x") for k in (3, 1, 2)] + [(1, "same", 2, "x"), (2, "same", 0, "y")], "doc_id long, text string, row_key int, row_rank string")
    for keep in (exact_dedup.keep_one, simhash.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns and [(r.doc_id, r.text) for r in out.collect()] == [(1, "same")]
