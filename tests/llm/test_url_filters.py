"""URL filters: which entry decides."""

import datetime as dt

from eventloom.llm.url_filters import filter_urls


def test_every_suffix_and_prefix_is_looked_up(spark):
    day = dt.date
    listed = [
        (0, "example.co.uk", "block", day(2024, 1, 1)), (0, "b.example.com", "block", day(2024, 1, 1)),
        (0, "example.com", "allow", day(2024, 1, 1)), (2, "x.org/a", "allow", day(2024, 1, 1)),
        (2, "x.org/a/b", "block", day(2024, 1, 1)), (1, "late.net", "block", day(2024, 3, 1)),
        (1, "late.net", "allow", day(2025, 6, 5)),
    ]
    asked = [
        ("http://www.example.co.uk/", day(2024, 2, 1), True), ("http://a.b.example.com/x", day(2024, 2, 1), True),
        ("http://c.example.com/x", day(2024, 2, 1), False), ("http://x.org/a/b/c?q=1", day(2024, 2, 1), True),
        ("http://x.org/a/c", day(2024, 2, 1), False), ("http://x.org/a/b/", day(2024, 2, 1), True),
        ("http://late.net/", day(2025, 6, 4), True), ("http://late.net/", day(2025, 6, 5), False),
        ("http://late.net/", day(2024, 2, 1), False), ("http://other.uk/", day(2024, 2, 1), False),
        ("nothing", day(2024, 2, 1), False), (None, day(2024, 2, 1), False), ("http://late.net/", None, False),
        ("http://localhost/", day(2024, 2, 1), False),
    ]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(asked)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame(listed, "rank int, pattern string, action string, day date")
    got = {r["page_id"]: r["blocked"] for r in filter_urls(captures, entries, "2024-12-31").collect()}
    assert got == {i: blocked for i, (_, _, blocked) in enumerate(asked)}
