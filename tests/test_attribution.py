"""Attribution against brute force on small random logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallymark.operators import attribution as a

BASE = datetime(2024, 3, 1)
EVENTS = "event_id long, ts timestamp_ntz, name string, message string, trace_id long"
SPANS = "span_id long, name string, start timestamp_ntz, end timestamp_ntz, trace_id long"


def _at(seconds):
    return None if seconds is None else BASE + timedelta(seconds=seconds)


def _data(seed, n_events=400, n_spans=60, broken=False):
    rnd = random.Random(seed)
    names = [f"tc_{i}" for i in range(12)] + ["ab", "Ünit"]
    events = []
    for i in range(n_events):
        # A third of the events fall into one minute.
        at = 5000 + rnd.random() * 60 if rnd.random() < 1 / 3 else rnd.random() * 20_000
        message = rnd.choice([None, "nothing", f"ran {rnd.choice(names).upper()} again", "xtc_1y"])
        events.append((i, round(at, 3), rnd.choice([None, None, *names]), message, rnd.choice([None, None, 1, 2])))
    spans = []
    for i in range(n_spans):
        start = rnd.choice([4990, rnd.randrange(20_000)])
        end = start + rnd.choice([0, 5, 60, 4000, 10**6])
        if broken:
            start, end = rnd.choice([(start, end), (None, end), (start, None), (None, None)])
        spans.append((i, rnd.choice([None, *names]), start, end, rnd.choice([None, 1, 3])))
    return events, spans


def _frames(spark, events, spans):
    return (
        spark.createDataFrame([(i, _at(t), n, m, x) for i, t, n, m, x in events], EVENTS),
        spark.createDataFrame([(i, n, _at(s), _at(e), x) for i, n, s, e, x in spans], SPANS),
    )


def _contains(message, name):
    return bool(message and name and name.lower() in message.lower())


@pytest.fixture(params=["1", "8", "40"])
def path(request, spark):
    """So many range partitions that values are carried over several, or none."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_long_span_over_many_short_ones_and_a_burst(spark):
    """Short spans win inside themselves only if they begin first; the long one is the earliest everywhere."""
    n = 20_000
    spans = spark.range(n).selectExpr(
        "id AS span_id", "concat('n', id) AS name", "timestamp_seconds(1000000 + id * 100) AS start", "timestamp_seconds(1000010 + id * 100) AS end")
    late = spans.withColumn("span_id", F.col("span_id") + n)
    long_span = spark.sql(f"SELECT {2 * n}L AS span_id, 'long' AS name, timestamp_seconds(1500000) AS start, timestamp_seconds(9000000000) AS end")
    events = spark.range(3000).selectExpr(
        "id AS event_id", "timestamp_seconds(CASE WHEN id < 2000 THEN 1400005 ELSE 1000005 + id * 100 + 60 * (id % 2) END) AS ts", "string(null) AS name", "string(null) AS message")
    got = {r.event_id: r.span_id for r in a.attribute_by_window(events, late.unionByName(long_span), buffer_seconds=0).collect()}
    assert set(got[i] for i in range(2000)) == {n + 4000}
    for i in range(2000, 3000):
        assert got[i] == (n + i if i % 2 == 0 else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_by_window(spark, path, seed):
    events, spans = _data(seed)
    found = a.attribute_by_window(*_frames(spark, events, spans), id_columns={"trace_id": "trace_id"}).collect()
    assert len(found) == len(events)
    got = {r.event_id: r.span_id for r in found}
    for i, t, name, _, trace in events:
        hits = [
            (s, sid) for sid, sname, s, e, strace in spans
            if (s - 30 <= t <= e + 30 and (name is None or name == sname)) or (trace is not None and trace == strace)
        ]
        assert got[i] == (min(hits)[1] if hits else None), i


def _repaired(events, spans):
    out = []
    for sid, name, s, e, _ in spans:
        seen = [t for _, t, n, m, _ in events if name is not None and (n == name or _contains(m, name))]
        start = s if s is not None else min(seen) if seen else e - 600 if e is not None else (datetime(2000, 1, 1) - BASE).total_seconds()
        end = e if e is not None else max(seen) if seen else start + 600
        out.append((sid, name, s is not None, start, end))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_cascade(spark, path, seed):
    events, spans = _data(seed, n_spans=25, broken=True)
    frames = _frames(spark, events, spans)
    repaired = _repaired(events, spans)
    bounds = {r.span_id: (r.known_start, r.start, r.end) for r in a.repair_bounds(frames[1], frames[0]).collect()}
    for sid, _, known, start, end in repaired:
        assert bounds[sid][0] == known
        assert abs((bounds[sid][1] - _at(start)).total_seconds()) < 1e-5
        assert abs((bounds[sid][2] - _at(end)).total_seconds()) < 1e-5
    found = a.attribute_cascade(*frames, default_id="none").collect()
    assert len(found) == len(events)
    got = {r.event_id: (r.span_id, r.match_kind) for r in found}
    for i, t, name, message, _ in events:
        hits = []
        for sid, sname, known, start, end in repaired:
            by_name, by_time = name is not None and name == sname, start - 30 <= t <= end + 30
            if by_name or by_time or _contains(message, sname):
                hits.append((known, start, sid, "name" if by_name else "time" if by_time else "message"))
        assert got[i] == ((str(min(hits)[2]), min(hits)[3]) if hits else ("none", "default")), i


@pytest.mark.parametrize("seed", [5, 6])
def test_by_ids(spark, path, seed):
    events, spans = _data(seed, n_spans=15)
    found = a.attribute_by_ids(*_frames(spark, events, spans), {"name": "name", "trace_id": "trace_id"}).collect()
    assert len(found) == len(events)
    got = {r.event_id: (r.span_id, r.match_kind) for r in found}
    own = {}
    for i, _, name, _, trace in events:
        hits = [(s, sid) for sid, sname, s, _, st in spans if (name and name == sname) or (trace and trace == st)]
        if hits:
            own[i] = min(hits)[1]
    ranges = {}
    for i, t, *_ in events:
        if i in own:
            lo, hi = ranges.get(own[i], (t, t))
            ranges[own[i]] = (min(lo, t), max(hi, t))
    for i, t, *_ in events:
        near = [(lo, sid) for sid, (lo, hi) in ranges.items() if lo - 10 <= t <= hi + 10]
        if i in own:
            assert got[i] == (str(own[i]), "id")
        elif near:
            assert got[i] == (str(min(near)[1]), "proximity")
        else:
            assert got[i] == ("fallback-" + _at(t).strftime("%Y-%m-%d %H:%M"), "minute")


def test_disjoint_windows_cross_partitions(spark):
    rnd = random.Random(7)
    rows = [(lo, lo + rnd.choice([0, 3, 40, 900]), i) for i, lo in enumerate(rnd.choices(range(1000), k=300))]
    windows = spark.createDataFrame(rows, "lo long, hi long, rank int")
    found = a.disjoint_windows(windows.repartition(6)).collect()
    owner = {}
    for r in found:
        for t in range(r.lo, r.hi + 1):
            assert t not in owner
            owner[t] = r["rank"]
    for t in range(2000):
        hits = [(lo, i) for lo, hi, i in rows if lo <= t <= hi]
        assert owner.get(t) == (min(hits)[1] if hits else None)


def test_no_spans_and_no_events(spark):
    events, spans = _frames(spark, *_data(8, n_events=5, n_spans=2))
    none = a.attribute_cascade(events, spans.limit(0))
    assert {r.match_kind for r in none.collect()} == {"default"}
    assert a.attribute_by_window(events.limit(0), spans).count() == 0


def test_missing_parents_counts_null_references(spark):
    children = spark.createDataFrame([(1,), (2,), (None,)], "p int")
    parents = spark.createDataFrame([(1,), (1,)], "id int")
    assert sorted((r.p for r in a.missing_parents(children, parents, {"p": "id"}).collect()), key=str) == [2, None]


def test_assigned_events_keep_their_span(spark):
    events = spark.createDataFrame(
        [(1, _at(0), None, None, None, 9), (2, _at(5), None, None, None, None), (3, _at(500), None, None, None, None)],
        EVENTS + ", had long",
    )
    spans = spark.createDataFrame([(7, "t", _at(0), _at(10), 1)], SPANS)
    by_window = {r.event_id: r.span_id for r in a.attribute_by_window(events, spans, assigned="had").collect()}
    assert by_window == {1: 9, 2: 7, 3: None}
    cascade = {r.event_id: (r.span_id, r.match_kind) for r in a.attribute_cascade(events, spans, assigned="had").collect()}
    assert cascade == {1: ("9", "assigned"), 2: ("7", "time"), 3: ("default", "default")}
    by_ids = {r.event_id: (r.span_id, r.match_kind) for r in a.attribute_by_ids(events, spans, {"trace_id": "trace_id"}, assigned="had").collect()}
    assert by_ids[1] == ("9", "assigned") and by_ids[2] == ("9", "proximity") and by_ids[3][1] == "minute"


def test_names_in_messages_of_all_lengths_and_spellings(spark):
    rnd = random.Random(9)
    letters = "abB_é"
    names = ["".join(rnd.choices(letters, k=k)) for k in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 40) for _ in range(6)] + ["", None, "a.b", "\n("]
    known = [n for n in names if n]
    messages = [None, "", "a", "x" * 20_000 + known[-3].upper(), *known]
    messages += [rnd.choice(known) + "".join(rnd.choices(letters, k=9)) + rnd.choice(known).lower() for _ in range(80)]
    events = spark.createDataFrame(list(enumerate(messages)), "event_id long, message string")
    found = a.names_in_messages(events, spark.createDataFrame([(n,) for n in names], "name string"), ["event_id"]).collect()
    wanted = {(i, n) for i, m in enumerate(messages) for n in known if _contains(m, n)}
    assert {(r.event_id, r.name) for r in found} == wanted and len(found) == len(wanted)
    nobody = spark.createDataFrame([(None,)], "name string")
    assert a.names_in_messages(events, nobody, ["event_id"]).count() == 0
    assert a.mention_times(events.withColumn("ts", F.current_timestamp()).limit(0), nobody).count() == 0


def test_a_hundred_thousand_names(spark):
    """Names that share every four letters with many others; most messages name nobody and meet no pattern."""
    n = 100_000
    spans = spark.range(n).selectExpr(
        "id AS span_id", "concat('Case_', lpad(id, 6, '0')) AS name", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS start", "CAST(null AS timestamp_ntz) AS end",
        "CAST(null AS long) AS trace_id")
    events = spark.range(20_000).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(5000000 + id) AS timestamp_ntz) AS ts", "string(null) AS name",
        "CASE WHEN id % 4 = 0 THEN concat('ran case_', lpad(id * 5, 6, '0'), ' and CASE_', lpad(id * 5 + 3, 6, '0')) ELSE 'case_ of nobody 0000' END AS message")
    hits = a.pattern_hits(events, a._patterns(spans), ["event_id"])
    assert hits.count() == 10_000
    repaired = a.repair_bounds(spans, events)
    told = {r.span_id: r.end for r in repaired.filter("end > timestamp_ntz'1970-02-20'").collect()}
    assert told == {i * 5 + d: datetime(1970, 1, 1) + timedelta(seconds=5_000_000 + i) for i in range(0, 20_000, 4) for d in (0, 3)}
    matched = a.with_message_match(events, spans.withColumn("rank", a.span_rank(F.col("start"), F.col("span_id"))), "hit")
    got = {r.event_id: r.hit.span_id if r.hit else None for r in matched.collect()}
    assert got == {i: i * 5 if i % 4 == 0 else None for i in range(20_000)}
