"""Queries against plain Python, where rows are many enough to show a cut."""

import pytest

from wayfold.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Five-second events: 40 sessions, the first with 1500 events in one minute's steps of the clock."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    rows = "SELECT id AS event_id, CASE WHEN id < 1500 THEN 1 ELSE id % 40 + 1 END AS user_id, timestamp_seconds(1704067200 + id) AS ts, 'click' AS event_type, 1.0D AS value FROM range(2, 3000) WHERE id % 29 <> 0"
    spark.sql(rows).write.parquet(f"{folder}/events.parquet")
    return folder


def relation(spark, folder, name):
    from wayfold.plans import scenario

    return scenario.relation(spark, folder, name).collect()


@pytest.mark.parametrize("folder", ["crowded", SF])
def test_kept_last_300(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "crowded" else folder
    by = {}
    for r in relation(spark, folder, "snap"):
        by.setdefault(r.session_id, []).append((r.line_no, r.t, r.snap_id))
    want = {(s, i) for s, rows in by.items() for _, t, i in sorted(rows)[-300:] if max(t for _, t, _ in rows) - t <= 300_000_000_000}
    got = [tuple(r) for r in QUERIES["kept_last_300"](spark, folder).select("session_id", "snap_id").collect()]
    assert sorted(got) == sorted(want)
    assert max(sum(s == k for s, _ in want) for k in by) > 20


def marks(points, every=60_000_000_000):
    """(k, t, lat, lng) of the marks between points in order, one at a time, each reached once."""
    out, k = [], 1
    for (_, t0, la0, ln0), (_, t1, la1, ln1) in zip(points, points[1:]):
        while t1 > t0 and points[0][1] + k * every <= t1:
            at = points[0][1] + k * every
            if at >= t0:
                part = (at - t0) / (t1 - t0)
                out.append((k, at, la0 + (la1 - la0) * part, ln0 + (ln1 - ln0) * part))
            k += 1
    return out


@pytest.mark.parametrize("name", ["time_markers", "route_markers"])
def test_markers_use_every_fix(spark, name):
    by, back = {}, 0
    for r in relation(spark, SF, "fix"):
        if r.lat:
            back += r.raw_id % 53 == 0
            by.setdefault((r.session_id, r.seq // 20 if name == "route_markers" else None), []).append((r.line_no, r.t, r.lat, r.lng))
    every = 600_000_000_000 if name == "time_markers" else 60_000_000_000
    want = {(s, part, k): (at, la, ln) for (s, part), rows in by.items() for k, at, la, ln in marks(sorted(rows), every)}
    got = {(r.session_id, getattr(r, "segment", None), r.k): r for r in QUERIES[name](spark, SF).collect()}
    assert back and set(got) == set(want)
    for key, (at, la, ln) in want.items():
        assert abs(got[key].lat - la) < 2e-9
        if name == "time_markers":
            assert got[key].t == at and abs(got[key].lng - ln) < 2e-9


def test_newest_sessions_lists_all(spark, crowded):
    want = sorted(((r.session_id, r.created) for r in relation(spark, crowded, "manifest")), key=lambda r: (-r[1], r[0]))
    assert len(want) == 40
    assert [tuple(r) for r in QUERIES["newest_sessions"](spark, crowded).collect()] == want
