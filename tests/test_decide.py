"""Decision pipeline: the fifteen replay scenarios as rows, and single rules."""

import math

import pytest

from wayfold.plans import decide as D

S = 1_000_000_000


def run(fixes, motions=(), forced=False):
    """fixes: (dlat, accuracy, seconds, speed); motions: (before fix k, t0, t1, samples)."""
    state = D.State(forced=forced)
    out = []
    for k, (dlat, acc, t, speed) in enumerate(fixes):
        for at, t0, t1, n in motions:
            if at == k:
                D.on_motion(state, D.Motion(int(t0 * S), int(t1 * S), n, 0.05, 0.83, True))
        d = D.step(state, D.Fix(k, int(t * S), 29.0 + dlat, 106.0, acc, speed))
        out.append((d["result"], d["reason"]))
    return out


JITTER, REFINED = ("reject", "stationary_accel_supported_jitter"), ("anchor", "stationary_anchor_refined")
GOOD, N = ("anchor", "first_fix_good"), None


@pytest.mark.parametrize("fixes,motions,forced,want", [
    ([(0, 10, 2, N), (0.00018, 3, 12, N)], (), False, [GOOD, ("accept", "moving_good_fix")]),
    ([(0, 10, 2, N), (0.00018, 31, 12, N)], (), False, [GOOD, ("weak", "weak_signal_stage1")]),
    ([(0, 45, 2, N)], (), True, [("anchor", "forced_weak_first_fix")]),
    ([(0, 45, 2, N)], (), False, [("weak", "weak_first_fix")]),
    ([(0, 10, 2, N), (0.01, 5, 3, N)], (), False, [GOOD, ("reject", "impossible_speed")]),
    ([(0, 10, 2, N), (0.000001, 10, 3, N), (0.000002, 10, 4, N)], (), False, [GOOD, JITTER, JITTER]),
    ([(0, 20, 2, 0.0), (0.001, 10, 130, 0.0)], (), False, [GOOD, ("accept", "gap_recovery")]),
    ([(0, 20, 2, 0.0), (0.00002, 8, 130, 0.0)], (), False, [GOOD, REFINED]),
    ([(0, 20, 2, 0.0), (0.00008, 3, 12, 0.0)], ((1, 7, 8.5, 6), (1, 9, 11, 6)), False, [GOOD, REFINED]),
    ([(0, 5, 2, 0.0), (0.000005, 5, 10, 0.0), (0.000006, 5, 31, 0.0), (0.00025, 5, 34, 1.0)], ((1, 7, 8.5, 12), (1, 9, 10.5, 12), (2, 30, 31.5, 12), (3, 32, 33.5, 12)), False,
     [GOOD, ("reject", "rest_candidate"), ("reject", "rest_paused_keepalive"), ("reject", "stationary_motion_blocked_recovery")]),
    ([(0, 10, 2, N), (0.0007, 5, 22, N), (0.0014, 5, 32, N), (0.0016, 5, 48, N)], (), False, [GOOD, ("reject", "transport_suspected"), ("reject", "transport_confirmed"), ("accept", "transport_recovery")]),
    ([(0, 10, 2, N), (0.00018, 3, 2, N)], (), False, [GOOD, ("reject", "non_positive_delta_time")]),
    ([(0, 10, 2, N), (0.00001, 10, 12, 0.9), (0.00002, 10, 22, 0.9)], (), False, [GOOD, ("reject", "stationary_keepalive"), ("reject", "stationary_jitter")]),
    ([(0, 10, 2, N), (0.0009, 5, 12, 10.0)], (), False, [GOOD, ("reject", "transport_suspected")]),
])
def test_scenarios(fixes, motions, forced, want):
    assert run(fixes, motions, forced) == want


def test_rest_recovery_opens_a_segment():
    out = run([(0, 20, 2, 0.0), (0.00002, 8, 130, 0.0), (0.0005, 5, 150, 2.0), (0.0008, 5, 170, 2.0)])
    assert out[1:] == [REFINED, ("reject", "rest_probing_confirming_moving"), ("accept", "rest_moving_recovery")]


def test_nan_position_moves_like_in_the_source():
    state = D.State()
    D.step(state, D.Fix(0, 2 * S, 29.0, 106.0, 5.0))
    assert D.step(state, D.Fix(1, 12 * S, math.nan, 106.0, 5.0))["reason"] == "moving_good_fix"


def frame(spark, rows):
    cols = "session_id long, line_no long, raw_id long, provider string, has_t boolean, t long, recv long, start_t long, lat double, lng double, acc double, speed double, mock boolean"
    return spark.createDataFrame(rows, cols)


def test_validation_rules_in_order(spark):
    ok = dict(session_id=1, provider="gps", has_t=True, t=5 * S, recv=5 * S, start_t=S, lat=29.0, lng=106.0, acc=5.0, speed=None, mock=False)
    cases = [({"provider": "network", "has_t": False}, "provider_not_gps"), ({"has_t": False}, "missing_elapsed_realtime"), ({"t": -1}, "before_record_start"), ({"t": 7 * S}, "location_from_future"),
             ({"recv": 36 * S}, "location_too_old"), ({"lat": 0.0, "lng": 0.0}, "zero_coordinate"), ({"lat": 91.0}, "zero_coordinate"), ({"lat": math.nan}, None), ({"acc": None}, "invalid_accuracy"), ({"acc": 0.0}, "invalid_accuracy"),
             ({"acc": 81.0}, "accuracy_too_large"), ({"mock": True}, "mock_location"), ({}, None)]
    names = "session_id line_no raw_id provider has_t t recv start_t lat lng acc speed mock".split()
    rows = [tuple((ok | c | {"session_id": k, "line_no": k, "raw_id": k})[n] for n in names) for k, (c, _) in enumerate(cases)]
    got = {r.raw_id: r.invalid for r in D.validated(frame(spark, rows)).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_batch_fold_equals_steps(spark):
    names = [(1, 4 * k, k, "gps", True, (2 + 10 * k) * S, (2 + 10 * k) * S, S, 29.0 + 0.0002 * k, 106.0, 4.0, None, False) for k in range(6)]
    motions = spark.createDataFrame([], "session_id long, line_no long, t0 long, t1 long, samples long, rms double, score double, still boolean")
    out = D.decide(frame(spark, names), motions).orderBy("decision_id").collect()
    assert [r.reason for r in out] == ["first_fix_good"] + ["moving_good_fix"] * 5
    assert [r.point_id for r in out] == [1, 2, 3, 4, 5, 6]
    stats = D.session_stats(D.decide(frame(spark, names), motions)).first()
    assert stats.metres == pytest.approx(5 * 22.239, abs=0.01) and stats.seconds == 50
    assert D.track_points(D.decide(frame(spark, names), motions)).count() == 6
