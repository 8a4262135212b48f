"""Collapsed runs against a plain walk, and agglomeration on small sequences."""

import json
import random
import time

import numpy as np

from moltide.llm import runs as RU

DIMERS = "dimer_id long, stream_id long, criterion string, frame int, pairs string, d_h_a_pairs string, items string"


def found(spark, rows, **kw):
    r = RU.runs(RU.contacts(spark.createDataFrame(rows, DIMERS)), **kw)
    return sorted((x["stream_id"], x["first_frame"], x["last_frame"], x["n_records"]) for x in r.collect())


def test_forms_of_lists(spark):
    rows = [
        (1, 1, "distance", 0, "[[1,2],[3,4]]", None, "x"), (2, 1, "distance", 1, "[ [4 , 3] , [2, 1], [1,2]]", None, "x"), (3, 1, "distance", 5, "[[[2,1]],[4,3]]", None, "x"),
        (4, 1, "distance", 6, "[1,2]", None, "x"), (5, 1, "distance", 7, "[[2,1]]", None, "x"), (5, 1, "distance", 7, "[[2,1]]", None, "x"),
        (6, 1, "distance", 8, None, None, "x"), (7, 1, "distance", 9, "[2,1]", None, "x"), (8, 1, "distance", 10, "[]", None, "x"), (9, 1, "distance", 11, "[]", None, "x"),
        (10, 2, "hbond", 0, None, "[9,5,7]", "x"), (11, 2, "hbond", 1, None, "[[9,6,7],[9,5,7]]", "x"), (12, 2, "hbond", 2, None, "[7,5,9]", "x"),
        (None, 2, "hbond", 3, None, "[7,5,9]", "x"), (13, None, "hbond", 3, None, "[7,5,9]", "x"), (14, 2, "hbond", None, None, "[7,5,9]", "x"),
    ]
    want = [(1, 0, 5, 3), (1, 6, 7, 2), (1, 9, 9, 1), (1, 10, 11, 2), (2, 0, 1, 2), (2, 2, 2, 1)]
    assert found(spark, rows) == want
    assert found(spark, []) == []


def test_stretches_change_nothing(spark):
    rng = random.Random(2)
    rows, state = [], [[1, 2]]
    for f in range(400):
        if rng.random() < 0.2:
            state = [[rng.randint(1, 3), 10 + rng.randint(0, 2)] for _ in range(rng.randint(0, 2))]
        rows.append((f, f // 250, "distance", f, None if rng.random() < 0.02 else json.dumps(state), None, "x"))
    whole = found(spark, rows)
    assert found(spark, rows, stretch=7) == whole
    seq, want = {}, []
    for r in rows:
        seq.setdefault(r[1], []).append((r[3], None if r[4] is None else frozenset(tuple(sorted(p)) for p in json.loads(r[4]))))
    for s, q in seq.items():
        i = 0
        while i < len(q):
            j = i
            while j + 1 < len(q) and q[i][1] is not None and q[j + 1][1] == q[i][1]:
                j += 1
            if q[i][1] is not None:
                want.append((s, q[i][0], q[j][0], j - i + 1))
            i = j + 1
    assert whole == sorted(want)


def test_near_runs(spark):
    sets = ["[[1,2],[3,4],[5,6]]", "[[1,2],[3,4],[7,8]]", "[[1,2],[3,4],[5,6],[7,8]]", "[[9,9]]", "[[9,9]]"]
    rows = [(i, 1, "distance", i, s, None, "x") for i, s in enumerate(sets)]
    assert found(spark, rows, min_similarity=0.7) == [(1, 0, 0, 1), (1, 1, 2, 2), (1, 3, 4, 2)]
    assert found(spark, rows, min_similarity=0.5, stretch=2) == [(1, 0, 2, 3), (1, 3, 4, 2)]
    apart = [(i, 1, "distance", 10 * i, "[1,2]", None, "x") for i in range(3)]
    assert found(spark, apart, max_gap=5) == [(1, 0, 0, 1), (1, 10, 10, 1), (1, 20, 20, 1)]


def test_most_similar_first():
    s = [frozenset("abc"), frozenset("abcd"), frozenset("abcde"), None, frozenset("x")]
    at = np.arange(5)
    runs, _ = RU.agglomerate(s, at, at, np.zeros(5, int), 0.76, None)
    assert runs == [[0], [1, 2], [3], [4]]


def test_stretches_change_no_near_run(spark):
    """Runs of near-identical records don't depend on where a stream is cut."""
    rng = random.Random(7)
    rows, state = [], set(range(6))
    for f in range(500):
        if rng.random() < 0.6:
            state = state ^ {rng.randint(0, 11)}
        rows.append((f, f // 400, "distance", f + 2 * (f % 7 == 0), json.dumps([[k, 100 + k] for k in sorted(state)]), None, "x"))
    for limit in (0.5, 0.8):
        whole = found(spark, rows, min_similarity=limit, stretch=1 << 20)
        assert found(spark, rows, min_similarity=limit, stretch=16) == whole and 10 < len(whole) < 400


def test_long_stream_of_similar_records_is_quick():
    """100,000 records that are all alike but for one contact of twenty: one run's sets stay bounded, and so does the time."""
    began = time.time()
    base = frozenset(range(20))
    sets = [base ^ {k % 17} for k in range(100_000)]
    at = np.arange(len(sets))
    runs, kinds = RU.agglomerate(sets, at, at, np.zeros(len(sets), int), 0.15, None)
    assert len(runs) == 1 and len(kinds[0][0]) == 3 and time.time() - began < 30
    assert len(RU.agglomerate(sets, at, at, np.zeros(len(sets), int), 0.8, None)[0]) > 10_000
