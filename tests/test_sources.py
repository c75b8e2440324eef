"""Feeds, pages and streams on small made-up inputs."""

import json

from almanac.sources import feeds
from almanac.streaming import streams


def _pages(spark, *bodies):
    return spark.createDataFrame([("https://example.org/a/", b) for b in bodies], "url string, body string")


def test_calendar_unfolds_unescapes_and_drops_zero_length(spark):
    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  name\\, here\r\nDTSTART;TZID=America/Chicago:20260701T190000\r\nDTEND;TZID=America/Chicago:20260701T190000\r\nLOCATION:Hall\\, 1 Main St\r\nSTATUS:CANCELLED\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nEND:VALARM\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    [row] = feeds.calendars(_pages(spark, body, None, "junk")).collect()
    assert (row.id, row.name, row.starts, row.ends, row.status, row.venue, row.address) == ("1", "Long name, here", "2026-07-02T00:00:00Z", None, "cancelled", "Hall", "1 Main St")


def test_json_feeds(spark):
    event = {"id": "x", "name": "N", "dates": {"start": {"dateTime": "2026-01-01T00:00:00Z"}, "status": {"code": "canceled"}}, "_embedded": {"venues": [{"name": "V", "city": {"name": "C"}, "location": {"latitude": "43.5", "longitude": "NaN"}}]}}
    [row] = feeds.valid(feeds.ticket_pages(_pages(spark, json.dumps({"_embedded": {"events": [event, {"id": "y", "name": "no start"}]}}), "{broken"))).collect()
    assert (row.id, row.status, row.venue, row.address, row.lat, row.lng, row.image) == ("x", "cancelled", "V", "C", 43.5, None, None)
    game = lambda k, home: {"gamePk": k, "gameDate": "d", "status": {"detailedState": "Postponed"}, "teams": {"home": {"team": {"id": home, "name": "H"}}, "away": {"team": {"id": 9, "name": "A"}}}}
    [row] = feeds.schedule_pages(_pages(spark, json.dumps({"dates": [{"games": [game(1, 5), game(2, 6)]}, {"games": []}]})), 5).collect()
    assert (row.id, row.name, row.status) == ("1", "H vs. A", "postponed")
    [row] = feeds.organizer_pages(_pages(spark, json.dumps({"events": [{"id": "e", "name": {"text": "T"}, "start": {"utc": "s"}, "venue": None, "is_free": True}]}))).collect()
    assert (row.id, row.name, row.venue, row.is_free) == ("e", "T", None, True)
    [row] = feeds.upcoming_pages(_pages(spark, json.dumps({"upcoming": [{"id": "u", "title": "T", "startDate": 0, "fullUrl": "/p", "location": {"addressTitle": "", "addressLine1": "1 St"}}]}))).collect()
    assert (row.url, row.starts, row.ends, row.venue, row.address) == ("https://example.org/p", "1970-01-01T00:00:00Z", None, None, "1 St")


def test_linked_data_and_site_map(spark):
    nodes = {"@graph": [{"@type": "MusicEvent", "name": "M", "url": "../b", "startDate": "2026-01-01", "location": "Place", "offers": [{"price": "0"}]}, {"@type": "Person", "name": "P"}]}
    page = f'<html><script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps(nodes)}</script><script type="application/ld+json">[{{"@type":["X","Festival"],"name":"F","location":{{"address":"A","geo":{{"latitude":"1e999"}}}}}}]</script></html>'
    one, two = sorted(feeds.linked_data(_pages(spark, page, "")).collect(), key=lambda r: r.name, reverse=True)
    assert (one.id, one.venue, one.is_free, one.status) == ("https://example.org/b", "Place", True, "scheduled")
    assert (two.id, two.address, two.lat, two.is_free) == ("F||", "A", None, None)
    urls = "<urlset><url><loc>u1</loc></url><url><loc>a&amp;b</loc><lastmod>2026-01-01</lastmod></url><url><loc>u3</loc><lastmod>2026-02-01</lastmod></url><url><loc>u4</loc></url></urlset>"
    assert [r.loc for r in feeds.site_map(_pages(spark, urls), 3).collect()] == ["u3", "a&b", "u1"]


def test_registry_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id":"1","name":"A","lon":1,"lat":2}\n{"id":"2"}\nnot json\n')
    good, broken = feeds.registry_lines(spark, str(tmp_path / "r.jsonl"))
    assert [r.id for r in good.collect()] == ["1"] and broken.count() == 2


def test_streams(spark, tmp_path):
    at = lambda k: f"2026-01-01 00:{k:02d}:00"
    rows = [("s", "1", at(0), '{"a":1,"b":2}'), ("s", "1", at(1), '{"b":2,"a":1}'), ("s", "1", at(2), '{"a":2}')]
    spark.createDataFrame(rows, "source string, id string, ts string, payload string").selectExpr("source", "id", "cast(ts AS timestamp) ts", "payload").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("source string, id string, ts timestamp, payload string").parquet(str(tmp_path / "in"))
    streams.new_payloads(read(), ["source", "id"], "ts").writeStream.format("memory").queryName("landed").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("landed").count() == 2
    streams.sliding_counts(read(), "id", "ts", "60 minutes", "60 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [3]
    streams.upsert_into(read(), str(tmp_path / "out"), ["source", "id"], "ts", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.payload for r in streams.latest(spark, str(tmp_path / "out"), ["source", "id"], "ts").collect()] == ['{"a":2}']
