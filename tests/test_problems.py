"""The general operators against brute force, and their defined edge cases."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions.instants import double_us, integer_us, parse_batch, zone_table
from brindle.operators import changefeed, dedup, lateness, skew, timestamps
from brindle.plans import problems
from brindle.session import table
from tests.conftest import DATA

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(d: datetime) -> int:
    return (d - EPOCH) // timedelta(microseconds=1)


# ---------------------------------------------------------------------------------------------
# instants, by a second, row-wise implementation


def brute(text, zone, day_first, own):
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d{9,19}", t):
        return int(t) * {10: 10**6, 13: 10**3, 16: 1}[len(t)]
    months = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(.*)", t):
        y, mo, d, h, mi, s = map(int, m.groups()[:6])
        frac, tail = m[7] or "", m[8].strip()
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(Z)", t):
        y, mo, d, h, mi, s = map(int, m.groups()[:6])
        frac, tail = "", "Z"
    elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d) (AM|PM)", t):
        a, b, y, h, mi, s = map(int, m.groups()[:6])
        d, mo = (a, b) if day_first else (b, a)
        h, frac, tail = h % 12 + 12 * (m[7] == "PM"), "", ""
    elif m := re.fullmatch(r"(\d\d)\.(\d\d)\.(\d{4}) (\d\d):(\d\d):(\d\d)", t):
        d, mo, y, h, mi, s = map(int, m.groups())
        frac, tail = "", ""
    elif m := re.fullmatch(r"\w{3}, (\d\d) (\w{3}) (\d{4}) (\d\d):(\d\d):(\d\d) (.*)", t):
        d, mo, y, h, mi, s = int(m[1]), months[m[2]], *map(int, m.groups()[2:6])
        frac, tail = "", m[7]
    elif m := re.fullmatch(r"\w{3} (\w{3}) (\d\d) (\d{4}) (\d\d):(\d\d):(\d\d) GMT(.*)", t):
        mo, d, y, h, mi, s = months[m[1]], int(m[2]), *map(int, m.groups()[2:6])
        frac, tail = "", m[7]
    else:
        return None
    try:
        wall = datetime(y, mo, d, h, mi, s, int((frac + "000000")[:6]))
    except ValueError:
        return None
    if tail in ("Z", "z"):
        return us(wall.replace(tzinfo=UTC))
    if m := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", tail):
        off = (1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
        return us(wall.replace(tzinfo=UTC)) - off // timedelta(microseconds=1)
    if tail and "/" not in tail:  # abbreviations of the client's zone
        z = ZoneInfo(zone or "UTC")
        offsets = {(datetime(2024, k, 15, tzinfo=z)).tzname(): datetime(2024, k, 15, tzinfo=z).utcoffset() for k in range(1, 13)}
        off = offsets.get(tail, timedelta(0) if tail in ("GMT", "UTC") else None)
        return None if off is None else us(wall.replace(tzinfo=UTC)) - off // timedelta(microseconds=1)
    z = ZoneInfo(tail or zone or "UTC")
    first, second = (us(wall.replace(tzinfo=z, fold=k).astimezone(UTC)) for k in (0, 1))
    if second < first:  # skipped: the offset before the change
        return first
    return second if own is None or second <= own else first


@pytest.mark.parametrize("root", [DATA, "/root/testdata/sf0.01"])
def test_every_created_at_agrees_with_brute_force(spark, root):
    rows = table(spark, root, "firehose")
    clients = {r["client"]: r for r in table(spark, root, "clients").collect()}
    got = timestamps.firehose_instants(rows, table(spark, root, "clients")).select("row_id", "commit.record.createdAt", "commit.record.via", "arrived_us", "created_us")
    bad = []
    for r in got.collect():
        c = clients.get(r["via"])
        want = brute(r["createdAt"], c and c["zone"], c and c["day_first"], r["arrived_us"])
        if want != r["created_us"]:
            bad.append((r, want))
    assert not bad, bad[:5]


def parse(*rows):
    t, z, d, o = zip(*rows)
    return parse_batch(pa.array(t, pa.string()), pa.array(z, pa.string()), pa.array(d, pa.bool_()), pa.array(o, pa.int64())).to_pylist()


def test_daylight_saving_edges():
    late = us(datetime(2025, 1, 1, tzinfo=UTC))
    berlin = us(datetime(2024, 10, 27, 1, 30, tzinfo=UTC))
    sydney = us(datetime(2024, 10, 5, 16, 30, tzinfo=UTC))
    got = parse(
        ("2024-10-27 02:30:00", "Europe/Berlin", None, late),
        ("2024-10-27 02:30:00", "Europe/Berlin", None, berlin - 1),
        ("2024-10-27 02:30:00", "Europe/Berlin", None, None),
        ("2024-10-06 02:30:00", "Australia/Sydney", None, late),
        ("2024-11-03 01:30:00 EDT", "America/New_York", None, late),
        ("2024-11-03 01:30:00 EST", "America/New_York", None, late),
        ("2024-10-27 02:30:00 Europe/Berlin", "Asia/Tokyo", None, late),
    )
    assert got == [berlin, berlin - 3600 * 10**6, berlin, sydney, us(datetime(2024, 11, 3, 5, 30, tzinfo=UTC)), us(datetime(2024, 11, 3, 6, 30, tzinfo=UTC)), berlin]


def test_texts_that_name_no_instant():
    texts = [None, "", " ", "now", "n/a", "--T--", "Invalid Date", "2024-10-32T09:12:44Z", "0000-00-00T00:00:00Z", "2024-11-05T25:61:00Z", "2024-02-30 00:00:00", "13/13/2024 01:00:00 AM",
             "2024-10-10 10:00:00 XYZ", "2024-10-10 10:00:00 No/Where", "2024-10-10T10:00:00+99:00", "２０２４-10-10T10:00:00Z", "9" * 500, "2024-10-10X10:00:00Z", "10/10/2024 13:00:00 AM"]
    assert parse(*[(t, None, None, None) for t in texts]) == [None] * len(texts)


def test_fractions_units_and_leap_days():
    got = parse(
        ("2024-02-29T00:00:00.1234567899Z", None, None, None),
        ("1727916538.25", None, None, None),
        ("1727916538123", None, None, None),
        ("1727916538123456789", None, None, None),
        ("\t 2024-10-03t00:00:00z \n", None, None, None),
        ("03/10/2024 12:00:00 AM", None, True, None),
    )
    day = us(datetime(2024, 10, 3, tzinfo=UTC))
    assert got == [us(datetime(2024, 2, 29, tzinfo=UTC)) + 123456, 1727916538250000, 1727916538123000, 1727916538123456, day, day]


def test_long_and_foreign_zone_names_far_years_and_long_fractions():
    noon = us(datetime(2024, 10, 3, 10, tzinfo=UTC))
    names = ("Mitteleuropäische Sommerzeit", "Central European Summer Time, as printed by a client that likes to say very much", "中欧夏令时间", "")
    assert parse(*[(f"Thu Oct 03 2024 12:00:00 GMT+0200 ({n})", None, None, None) for n in names]) == [noon] * 4
    berlin = [us(datetime(y, 7, 1, 12, tzinfo=ZoneInfo("Europe/Berlin")).astimezone(UTC)) for y in (2059, 2061, 2099)]
    assert parse(*[(f"{y}-07-01 12:00:00", "Europe/Berlin", None, None) for y in (2059, 2061, 2099)]) == berlin
    far, old = us(datetime(9998, 7, 1, 10, tzinfo=UTC)), us(datetime(1900, 7, 1, 11, tzinfo=UTC))
    assert parse(("9998-07-01 12:00:00", "Europe/Berlin", None, None), ("1900-07-01 12:00:00", "Europe/Berlin", None, None)) == [far, old]
    assert parse(("2024-10-03T10:00:00." + "0" * 300 + "Z", None, None, None)) == [noon]


def test_number_units(spark):
    rows = spark.createDataFrame([(1, 1727916538.0), (2, 1727916538123.0), (3, float("nan")), (4, 0.0), (5, -1.0), (6, None), (7, float("inf")), (8, 1727916538.000001)], "k int, x double")
    assert [r[0] for r in rows.orderBy("k").select(double_us(F.col("x"))).collect()] == [1727916538000000, 1727916538123000, None, None, None, None, None, 1727916538000001]
    rows = spark.createDataFrame([(1, 1727916538), (2, 1727916538123), (3, 1727916538123456), (4, 1727916538123456789), (5, 0), (6, None)], "k int, x long")
    assert [r[0] for r in rows.orderBy("k").select(integer_us(F.col("x"))).collect()] == [1727916538000000, 1727916538123000, 1727916538123456, 1727916538123456, None, None]


def test_zone_tables_match_the_zone_database():
    for name in ("Europe/London", "America/Sao_Paulo", "Asia/Kathmandu", "Africa/Casablanca", "Australia/Lord_Howe"):
        t, z = zone_table(name), ZoneInfo(name)
        for k in range(0, 20_000, 7):
            at = datetime(1971, 1, 1, tzinfo=UTC) + timedelta(days=k, hours=k % 24)
            i = int(np.searchsorted(t.at, at.timestamp(), side="right"))
            assert t.offset[i] == at.astimezone(z).utcoffset().total_seconds(), (name, at)


def test_empty_tables_and_extra_columns(spark):
    f = table(spark, DATA, "firehose").limit(0).withColumn("seq", F.lit(1)).withColumn("key", F.lit("x"))
    c, p, r = (table(spark, DATA, n).limit(0) for n in ("clients", "posts", "reactions"))
    assert timestamps.normalised_stamps(f, p, c).count() == 0
    assert changefeed.repo_records(f).count() == 0
    assert dedup.redundant_messages(f, r).count() == 0
    assert skew.heavy_log_keys(r, p).count() == 0
    assert lateness.late_rows(lateness.created_events(f, c).unionByName(lateness.reaction_events(r))).count() == 0


# ---------------------------------------------------------------------------------------------
# change feed


def test_changes_in_any_order_give_one_state(spark):
    rows = [("a", "3", " Create", "x"), ("a", "5", "DELETE ", None), ("a", "4", "update", "y"), ("b", "1", "update", "z"), ("b", "1", "update", "z"), ("c", "2", "create", "w"), ("c", None, "delete", None), ("d", "1", "noop", "v"), (None, "1", "create", "n")]
    schema = "k string, v string, o string, p string"
    want = {("b", "1", "z"), ("c", "2", "w"), (None, "1", "n")}
    rng = np.random.default_rng(0)
    for _ in range(3):
        mixed = [rows[i] for i in rng.permutation(len(rows))]
        state = changefeed.fold_changes(spark.createDataFrame(mixed, schema), ["k"], "v", "o", ["p"])
        assert {tuple(r) for r in changefeed.live_rows(state, ["k"], "v", ["p"]).collect()} == want
    # delivered in two parts, the late one older than the tombstone
    first = changefeed.fold_changes(spark.createDataFrame(rows[1:], schema), ["k"], "v", "o", ["p"])
    both = changefeed.fold_changes(spark.createDataFrame(rows[:1], schema), ["k"], "v", "o", ["p"], base=first)
    assert {tuple(r) for r in changefeed.live_rows(both, ["k"], "v", ["p"]).collect()} == want


# ---------------------------------------------------------------------------------------------
# lateness


def test_late_rows_agree_with_brute_force(spark):
    clients, fire = table(spark, DATA, "clients"), timestamps.firehose_instants(table(spark, DATA, "firehose"), table(spark, DATA, "clients"))
    first: dict = {}
    for r in fire.collect():
        c = r["commit"]
        if r["kind"] == "commit" and (c["operation"] or "").strip().lower() == "create":
            k = ("firehose", r["did"], c["rev"], c["collection"], c["rkey"])
            if k not in first or r["row_id"] < first[k][0]:
                first[k] = (r["row_id"], r["created_us"], r["arrived_us"])
    for r in table(spark, DATA, "reactions").collect():
        if r["timestamp"] > 0:
            k = ("reactions", r["shard"], r["msg_id"]) if r["msg_id"] is not None else ("reactions", r["user_id"], r["post_id"], r["kind"], r["timestamp"])
            if k not in first or r["ordinal"] < first[k][0]:
                first[k] = (r["ordinal"], round(r["timestamp"] * 1e6), r["arrived_us"])
    want = set()
    hour = 3600 * 10**6
    for k, (row, happened, arrived) in first.items():
        if happened is not None:
            behind = arrived - (happened // hour + 1) * hour
            if behind > 600 * 10**6:
                want.add((k[0], row, "correction" if behind <= 24 * hour else "too_late"))
    assert {tuple(r) for r in problems.p2_found(spark, DATA).collect()} == want
    assert clients.count() == 24


def test_period_aggregates_merge_slices(spark):
    rng = np.random.default_rng(1)
    hour = 3600 * 10**6
    rows = [("s", i, int(h), int(h + a)) for i, (h, a) in enumerate(zip(rng.integers(0, 3 * hour, 400), rng.integers(0, 30 * hour, 400)))]
    rows += [("s", 1000, 5, 6), ("s", 1001, 5, 6), ("s", 1002, None, 6), ("s", 1003, 5, None)]
    rows += [("s", 2000 + i, 50 * hour, 50 * hour) for i in range(2)]  # one instant, nothing else in its hour
    events = lateness.kslack(spark.createDataFrame(rows, "src string, row_id long, happened_us long, arrived_us long"))
    got = {r["period_us"]: r for r in lateness.period_aggregates(events, ["src"], "row_id").collect()}
    for p in (0, 1, 2, 50):
        inside = [(h, i, a - (p + 1) * hour) for _, i, h, a in rows if h is not None and a is not None and h // hour == p]
        out = sorted((h, i) for h, i, b in inside if b <= 24 * hour)
        r = got[p * hour]
        assert (r["n"], r["too_late"]) == (len(out), len(inside) - len(out))
        assert r["provisional_n"] == sum(b <= 600 * 10**6 for _, _, b in inside)
        assert (r["first_row"], r["last_row"]) == (out[0][1], out[-1][1])
        assert r["longest_gap_us"] == max(b[0] - a[0] for a, b in zip(out, out[1:]))


def test_buffers_publish_what_they_hold_at_the_end_of_the_grace(spark):
    rng = np.random.default_rng(5)
    hour = 3600 * 10**6
    rows = [("st"[i % 2], i, int(h), int(h + a)) for i, (h, a) in enumerate(zip(rng.integers(0, 4 * hour, 900), rng.exponential(hour, 900)))]
    rows += [("s", 5000 + i, int(h), int(h) + 3 * hour) for i, h in enumerate(range(0, hour, hour // 7))]
    events = spark.createDataFrame(rows, "src string, row_id long, happened_us long, arrived_us long").repartition(3)
    got = lateness.kslack(events, publish=["src"]).collect()
    told: dict = {}
    for r in got:
        if r["verdict"] == "provisional":
            told[r["src"], r["period_us"]] = told.get((r["src"], r["period_us"]), 0) + r["held"]
    want: dict = {}
    for s, _, h, a in rows:
        p = h // hour * hour
        if a <= p + hour + lateness.Slack().grace_us:
            want[s, p] = want.get((s, p), 0) + 1
    assert told == want and sum(r["verdict"] != "provisional" for r in got) == len(rows)


# ---------------------------------------------------------------------------------------------
# skew


def test_weighted_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    values = {"hot": rng.normal(0, 1e6, 3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "wide": np.array([-1e300, 1e300, 0.0, 1e-300])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), (None, 1.0), ("ties", float("nan"))]
    pairs = skew.compressed(spark.createDataFrame(rows, "k string, v double"), F.col("k"), F.col("v"))
    for p in (0.0, 0.5, 0.9, 1.0):
        got = {r["key"]: r["percentile"] for r in skew.weighted_percentile(pairs, p).collect()}
        for k, vs in values.items():
            assert got[k] == np.sort(vs)[max(1, int(np.ceil(len(vs) * p))) - 1], (k, p)
        assert got[None] == 1.0 and "none" not in got
    stats = {r["key"]: r for r in skew.key_statistics(pairs).collect()}
    assert stats["ties"]["n"] == 501 and stats["ties"]["n_value"] == 500 and stats["none"]["mean_value"] is None
    assert [r["key"] for r in skew.heavy_keys(pairs, 2).collect()] == ["hot"]


# ---------------------------------------------------------------------------------------------
# copies


def test_nulls_are_values_and_the_first_copy_stays(spark):
    rows = [("x", 5, "a", None), ("x", 3, "a", None), ("x", 9, "a", "b"), ("x", 40_000, "a", None), ("x", 70_000, None, None), ("x", 80_001, None, None)]
    df = spark.createDataFrame(rows, "src string, row_id long, p string, q string")
    got = dedup.redundant_arrivals([(df, ["p", "q"])], df, "src", "row_id")
    assert {r["row_id"] for r in got.collect()} == {5, 40_000, 80_001}


def test_seen_store_over_deliveries(spark, tmp_path):
    reactions = table(spark, DATA, "reactions")
    numbered, plain = dedup.reaction_messages(reactions)
    want = {r["row_id"] for r in reactions.select(F.col("ordinal").alias("row_id")).collect()} - {r["row_id"] for r in problems.p6_found(spark, DATA).filter("src = 'reactions'").collect()}
    edge = reactions.approxQuantile("ordinal", [0.5], 0.0)[0]
    kept = set()
    for rows, ident, number, name in ((numbered, ["shard"], "msg_id", "n"), (plain, ["user_id", "post_id", "kind", "timestamp"], None, "p")):
        store = dedup.SeenStore(spark, str(tmp_path / name), shards=4)
        for part in (rows.filter(F.col("row_id") <= edge), rows.filter(F.col("row_id") > edge)):
            kept |= {r["row_id"] for r in store.ingest(part, ident, "row_id", number).collect()}
        assert store.ingest(rows, ident, "row_id", number).count() == 0  # given again
    assert kept == want


def test_deliveries_through_the_store_give_the_copies_of_one_grouping(spark):
    f, r = table(spark, DATA, "firehose"), table(spark, DATA, "reactions")
    commits, (numbered, plain) = dedup.commit_messages(f), dedup.reaction_messages(r)
    arrivals = commits.select("src", "row_id").union(r.select(F.lit("reactions"), "ordinal"))
    parts = [(commits, ["did", "rev", "collection", "rkey"]), (numbered, ["shard", "msg_id"]), (plain, ["user_id", "post_id", "kind", "timestamp"])]
    want = {tuple(x) for x in dedup.redundant_arrivals(parts, arrivals, "src", "row_id").collect()}
    for n in (1, 4):
        assert {tuple(x) for x in dedup.redundant_messages(f, r, n).collect()} == want


def test_of_two_deliveries_at_once_one_is_published(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    store, other = (dedup.SeenStore(spark, str(tmp_path / "s")) for _ in range(2))
    before = other.current()
    assert {r["n"] for r in store.ingest(rows, ["k"], "n").collect()} == {1, 2}
    other.current = lambda: before
    with pytest.raises(RuntimeError):
        other.ingest(spark.createDataFrame([("c", 4)], "k string, n long"), ["k"], "n")
    assert {r["n"] for r in store.kept().collect()} == {1, 2}
    # bits are united in time, and nothing comes back
    for i in range(9):
        assert [r["n"] for r in store.ingest(spark.createDataFrame([("a", 90), (f"x{i}", 100 + i)], "k string, n long"), ["k"], "n").collect()] == [100 + i]
    assert len(store.current()["bitmaps"]) < store.COMPACT
