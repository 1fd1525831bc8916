import numpy as np
import pandas as pd
import pytest
from quillstream.functions import instants, zones
from quillstream.operators import timestamps


@pytest.fixture(scope="module")
def tables():
    return zones.load(["Europe/London", "Europe/Berlin", "America/New_York", "Asia/Kolkata"])


@pytest.mark.parametrize(
    ("raw", "zone", "order", "utc"),
    [
        ("2015-01-10T01:11:30+02:00", None, None, "2015-01-09T23:11:30.000"),
        ("Fri, 01 Apr 2022 17:42:53 PDT", None, None, "2022-04-02T00:42:53.000"),
        ("1 mars 2019 à 20h20", "Europe/Berlin", "dmy", "2019-03-01T19:20:00.000"),
        ("03/04/2020 3:05 p.m.", "America/New_York", "mdy", "2020-03-04T20:05:00.000"),
        ("03/04/2020 3:05 p.m.", "Europe/London", "dmy", "2020-04-03T14:05:00.000"),
        ("20200304150203", "Asia/Kolkata", "dmy", "2020-03-04T09:32:03.000"),
        ("1506799188.665", None, None, "2017-09-30T19:19:48.665"),
        ("1578000913859294", None, None, "2020-01-02T21:35:13.859"),
        ("2017-10-29T05:30:26.559333458-0400", None, None, "2017-10-29T09:30:26.559"),
        ("2015年11月18日 4時39分", "Asia/Kolkata", "dmy", "2015-11-17T23:09:00.000"),
        ("00:27 MSK, 13 октября 2024", None, None, "2024-10-12T21:27:00.000"),
        ("12:00 AM", "Europe/London", "dmy", None), ("2024-03-31 01:46", "Europe/London", "dmy", None), ("2024-10-27 01:46", "Europe/London", "dmy", None),
        ("31/02/2020 09:10", "Europe/London", "dmy", None), ("2020-01-02", "Europe/London", "dmy", None), ("yesterday", "Europe/London", "dmy", None), ("", None, None, None),
        ("2020-01-02 10:00", None, None, None), ("9" * 5000, None, None, None), ("2021-05-06 07:08 +99:00", None, None, None),
    ],
)
def test_instants(tables, raw, zone, order, utc):
    out = instants.read_instants(pd.Series([raw]), pd.Series([zone], dtype=object), pd.Series([order], dtype=object), tables)
    want = None if utc is None else int((pd.Timestamp(utc) - pd.Timestamp(0)).total_seconds() * 1000 + 0.5)
    got = out["utc_ms"][0]
    assert (None if pd.isna(got) else int(got)) == want


def test_gap_and_overlap_are_told_apart(tables):
    out = instants.read_instants(pd.Series(["2024-03-31 01:46", "2024-10-27 01:46"]), pd.Series(["Europe/London"] * 2), pd.Series(["dmy"] * 2), tables)
    assert list(out["status"]) == ["nonexistent", "ambiguous"]


def test_operator_edge_cases(spark):
    rows = [(1, 1, "2020-01-02T03:04:05+01:00", None, "x"), (1, 1, "2020-01-02T03:04:05+01:00", None, "x"), (2, None, "2020-01-02 03:04", "", "y"), (3, 9, None, None, None), (4, 1, "2020-01-02T03:04:05Z", " 2020-01-02T03:04:05Z ", "z")]
    df = spark.createDataFrame(rows, "meta_id int, site_id int, published_at string, modified_at string, raw string")
    sites = spark.createDataFrame([(1, "Europe/Berlin", "dmy"), (1, "Europe/Paris", "mdy")], "site_id int, time_zone string, date_order string")
    made = timestamps.normalise_times(df, sites, ["meta_id"], ["published_at", "modified_at"])
    found = sorted(tuple(r) for r in timestamps.changed_times(made, ["meta_id"]).collect())
    assert found == [(1, "published_at", 1577930645000)] * 2 + [(4, "modified_at", 1577934245000)]
    status = {(r["meta_id"], r["field_name"]): r["status"] for r in made.collect()}
    assert status[2, "published_at"] == "no_zone" and status[2, "modified_at"] == "unread" and (3, "published_at") not in status
    assert timestamps.normalise_times(df.limit(0), sites, ["meta_id"], ["published_at"]).count() == 0


def test_long_values_and_late_years():
    tables = zones.load(["Europe/Berlin"])
    read = lambda v: tuple(instants.read_instants(pd.Series([v]), pd.Series(["Europe/Berlin"]), pd.Series(["dmy"]), tables).iloc[0][["utc_ms", "status"]])
    for year in (2024, 2099, 2100, 2150, 2400):
        for month, hour in ((1, 11), (7, 10)):
            want = int(np.datetime64(f"{year}-{month:02d}-01T{hour}:00", "ms").astype("int64"))
            assert read(f"{year}-{month:02d}-01 12:00") == (want, "ok")
    assert read("x" * 200_000)[1] == read("9" * 200_000)[1] == "unread"
    plain = read("Monday, 3 June 2024, 10:15:30 (Central European Summer Time)")
    assert read(" " * 300 + "Monday, 3 June 2024, 10:15:30 (Central European Summer Time)" + " " * 300) == plain
