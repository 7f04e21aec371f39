import pytest

from palimpsest.operators.timestamps import normal_times

BERLIN, NEW_YORK, TOKYO = "b", "n", "t"
CASES = [
    (BERLIN, "2023-06-01", "2023-06-01"),
    (BERLIN, " 20230408. ", "2023-04-08"),
    (BERLIN, "28/03/21 03:57", "2021-03-28T01:57:00.000Z"),
    (NEW_YORK, "10/14/2021", "2021-10-14"),
    (TOKYO, "21/08/29 20:59", "2021-08-29T11:59:00.000Z"),
    (BERLIN, "30.02.2022 10:00", None),
    (BERLIN, "the 30th of December 2022", "2022-12-30"),
    (NEW_YORK, "7:21 am on 23 Apr, 2021", "2021-04-23T11:21:00.000Z"),
    (NEW_YORK, "September 24th, 2022 at 2:09am", "2022-09-24T06:09:00.000Z"),
    (NEW_YORK, "12:30 am on 1 May, 2023", "2023-05-01T04:30:00.000Z"),
    (BERLIN, "Tue, 10 Jan 2023 12:44:54 +0100", "2023-01-10T11:44:54.000Z"),
    (BERLIN, "1680771596", "2023-04-06T08:59:56.000Z"),
    (BERLIN, "1684293848951", "2023-05-17T03:24:08.951Z"),
    (BERLIN, "2023-07-16 18:48:58.702951Z", "2023-07-16T18:48:58.702Z"),
    (BERLIN, "２５ February, ２０２２", "2022-02-25"),
    (BERLIN, "26. April 2023, 19:28 Uhr", "2023-04-26T17:28:00.000Z"),
    (BERLIN, "9 de diciembre de 2022, 9:58 p.m.", "2022-12-09T20:58:00.000Z"),
    (TOKYO, "2021年3月22日 13:20", "2021-03-22T04:20:00.000Z"),
    (TOKYO, "2023年7月14日16時07分", "2023-07-14T07:07:00.000Z"),
    (BERLIN, "2024-11-03T02:29:40[America/New_York]", "2024-11-03T07:29:40.000Z"),
    (BERLIN, "2022-06-08 21:39 UTC+2", "2022-06-08T19:39:00.000Z"),
    (BERLIN, "2024-04-21 03:05 UTC+5:45", "2024-04-20T21:20:00.000Z"),
    (BERLIN, "20220628T162655Z", "2022-06-28T16:26:55.000Z"),
    # Occurs twice: the first; an abbreviation tells which.
    (BERLIN, "2024-10-27 02:30", "2024-10-27T00:30:00.000Z"),
    (BERLIN, "27 Oct 2024 02:30 CET", "2024-10-27T01:30:00.000Z"),
    (NEW_YORK, "2024-11-03 01:30", "2024-11-03T05:30:00.000Z"),
    # Skipped: the offset before the change.
    (BERLIN, "2024-03-31 02:30", "2024-03-31T01:30:00.000Z"),
    (NEW_YORK, "2024-03-10 02:30", "2024-03-10T07:30:00.000Z"),
    (BERLIN, "it happened 2021-12-30, I think", "2021-12-30"),
    (BERLIN, "around noon? no: 2023/08/06 (Sun) 23:40", "2023-08-06T21:40:00.000Z"),
    (BERLIN, "2021-05-05 to 2021-05-06", None),
    (BERLIN, "May 2023", None),
    (BERLIN, "2022", None),
    (BERLIN, "0", None),
    (BERLIN, "Tuesday 14:00", None),
    (BERLIN, "0000-00-00 00:00:00", None),
    (BERLIN, "last Friday", None),
    (BERLIN, "", None),
    (BERLIN, "2021-04-05 25:10", None),
    ("unknown sample", "2021-04-05", "2021-04-05"),
    ("unknown sample", "2021-04-05 10:00", None),
    ("unknown sample", "2021-04-05 10:00Z", "2021-04-05T10:00:00.000Z"),
]
FACTS = "fact_id string, sample_id string, time_info struct<original_text:string,absolute_date:string>"


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame([(BERLIN, "Europe/Berlin", "dmy"), (NEW_YORK, "America/New_York", "mdy"), (TOKYO, "Asia/Tokyo", "ymd"), ("bad", "Nowhere/Land", None), (None, "UTC", "dmy")], "sample_id string, time_zone string, date_order string")
    mentions = spark.createDataFrame([(str(i), s, v) for i, (s, v, _) in enumerate(CASES)] + [("0", *CASES[0][:2]), (None, BERLIN, "2020-01-01"), ("n", None, None), ("long", BERLIN, "x " * 50_000)], "mention_id string, sample_id string, session_date string")
    facts = spark.createDataFrame([("f", BERLIN, ("2021-01-02", None)), ("g", BERLIN, None), ("h", "bad", (None, "3 May 2021"))], FACTS)
    return mentions, facts, samples


def test_normal_forms(tables):
    got = {(r.record_id, r.field_name): r.normal_form for r in normal_times(*tables).collect()}
    wrong = [(v, want, got[str(i), "session_date"]) for i, (_, v, want) in enumerate(CASES) if got[str(i), "session_date"] != want]
    assert not wrong
    assert got["f", "original_text"] == "2021-01-02" and got["h", "absolute_date"] == "2021-05-03" and got["long", "session_date"] is None
    assert len(got) == len(CASES) + 3


def test_empty_tables(spark, tables):
    m, f, s = tables
    assert normal_times(m.limit(0), f.limit(0), s).count() == 0
    assert normal_times(m.limit(0), f.limit(0), s.limit(0)).count() == 0
