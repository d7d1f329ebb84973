"""The preview source's bounds and streams, and the sink's two phases."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, LessThanOrEqual, StringContains

from sentria.sources import lines, ndjson, preview

PER_PAGE = 5


def page(channel, ids, older=None):
    posts = "".join(f'<div class="{preview.MESSAGE}" data-post="{channel}/{i}"><div class="{preview.BODY}">post {i}</div><span class="{preview.META}"><time datetime="2024-01-01T00:00:00Z"></time></span></div>' for i in ids)
    more = "" if older is None else f'<a class="{preview.MORE}" data-before="{older}"></a>'
    return f'{more}<section class="{preview.HISTORY}">{posts}</section>'


def served(newest):
    """A transport over channels of so many posts each, that counts what is fetched."""
    fetched = []

    def get(url):
        fetched.append(url.rpartition("/")[2])
        name, _, query = fetched[-1].partition("?")
        key, _, number = query.partition("=")
        last = newest[name]
        if key == "after":
            ids = range(int(number) + 1, min(int(number) + PER_PAGE, last) + 1)
        else:
            end = min(int(number) - 1, last) if number else last
            ids = range(max(1, end - PER_PAGE + 1), end + 1)
        return 200, url, page(name, ids, ids[0] if len(ids) and ids[0] > 1 else None).encode()

    return get, fetched


@pytest.mark.parametrize(("filters", "ids", "pages"), [
    ([], range(1, 41), 8), ([GreaterThan(("post_id",), 31)], range(32, 41), 2), ([GreaterThan(("post_id",), 35)], range(36, 41), 1), ([LessThan(("post_id",), 8)], range(1, 8), 2), ([EqualTo(("post_id",), 17)], [17], 1),
    ([GreaterThan(("post_id",), 12), LessThanOrEqual(("post_id",), 20), LessThan(("post_id",), 100)], range(13, 21), 2), ([GreaterThan(("post_id",), 12), LessThan(("post_id",), 13)], [], 0), ([LessThan(("post_id",), 1)], [], 0),
])
def test_bounds_are_pushed_to_the_pages(monkeypatch, filters, ids, pages):
    get, fetched = served({"chan1": 40})
    monkeypatch.setattr(preview, "_transport", lambda options: get)
    reader = preview._Bounded({"channels": "chan1"})
    other = StringContains(("text",), "x")
    assert list(reader.pushFilters([*filters, other])) == [other]
    rows = list(reader.read(reader.partitions()[0]))
    assert sorted(r[-1] for r in rows) == list(ids) and len(fetched) == pages


def write_pages(folder, channel, last, first=1):
    """Files as ``folder_transport`` asks for them."""
    get, _ = served({channel: last})
    Path(folder, f"{channel}.html").write_bytes(get(f"https://t.me/s/{channel}")[2])
    for n in range(first, last + 2):
        for key in ("before", "after"):
            Path(folder, f"{channel}-{key}-{n}.html").write_bytes(get(f"https://t.me/s/{channel}?{key}={n}")[2])
    Path(folder, f"{channel}-after-0.html").write_bytes(get(f"https://t.me/s/{channel}?after=0")[2])


def test_pushed_in_a_query(spark, tmp_path):
    write_pages(tmp_path, "chan1", 30)
    # fetching one of these would be an error
    for n in range(1, 12):
        (tmp_path / f"chan1-before-{n}.html").unlink()
    spark.dataSource.register(preview.PreviewSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("preview").option("channels", "chan1").option("pushdown", "true").option("folder", str(tmp_path)).load()
        assert sorted(r["post_id"] for r in rows.filter("post_id > 14 and post_id <= 22 and text is not null").collect()) == list(range(15, 23))
        with pytest.raises(Exception, match="not_found"):
            rows.filter("post_id > 2").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_of_channels(spark, tmp_path):
    """Two channels in one stream; a restart goes on where each was left; a channel that fails holds up no other."""
    pages = tmp_path / "pages"
    pages.mkdir()
    write_pages(pages, "chan1", 12)
    write_pages(pages, "other", 3)
    spark.dataSource.register(preview.PreviewSource)

    def run(channels="chan1,other,absent"):
        stream = spark.readStream.format("preview").option("channels", channels).option("folder", str(pages)).option("after", "2").load()
        q = stream.select("external_id", "text").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["external_id"] for r in spark.read.schema("external_id string").json(str(tmp_path / "out")).collect())

    first = [f"chan1/{i}" for i in range(3, 13)] + ["other/3"]
    assert run() == sorted(first)
    assert run() == sorted(first)
    write_pages(pages, "chan1", 14)
    write_pages(pages, "other", 9)
    assert run() == sorted([f"chan1/{i}" for i in range(3, 15)] + [f"other/{i}" for i in range(3, 10)])


def test_reader_of_streams(monkeypatch):
    get, fetched = served({"chan1": 12, "other": 3})
    monkeypatch.setattr(preview, "_transport", lambda options: get)
    reader = preview._Follow({"channels": "chan1, other"})
    end = reader.latestOffset()
    assert end == {"chan1": 12, "other": 3} and fetched == ["chan1", "other"]
    parts = reader.partitions(reader.initialOffset() | {"other": 3}, end)
    assert [(p.name, p.after, p.until) for p in parts] == [("chan1", 0, 12)]
    # posts that came meanwhile wait for their own batch
    get, fetched = served({"chan1": 30})
    assert [r[-1] for r in reader.read(parts[0])] == list(range(1, 13)) and len(fetched) == 3
    silent = preview._Follow({"channels": "gone"})
    monkeypatch.setattr(preview, "_transport", lambda options: lambda url: (404, url, b""))
    with pytest.raises(preview.SourceError, match="not_found"):
        silent.latestOffset()


def values(folder):
    return sorted(line for f in Path(folder).glob("*=*/*.json") for line in f.read_text().splitlines())


def test_sink_in_two_phases(tmp_path):
    sink = lines.LinesSink({"path": str(tmp_path)}).streamWriter(None, False)
    first = [sink.write(iter([("a",), ("b",)])), sink.write(iter([("c",)])), sink.write(iter([]))]
    assert values(tmp_path) == [] and [m.lines for m in first] == [2, 1, 0]
    sink.commit(first, 0)
    assert values(tmp_path) == ["a", "b", "c"]
    # the same batch again: one copy
    again = lines.LinesSink({"path": str(tmp_path)}).streamWriter(None, False)
    again.commit([again.write(iter([("a",), ("b",), ("c",)]))], 0)
    assert values(tmp_path) == ["a", "b", "c"]
    # a batch that is given up: none
    sink.abort([sink.write(iter([("x",)])), None], 1)
    assert values(tmp_path) == ["a", "b", "c"] and not [f for f in tmp_path.rglob("*") if f.is_file() and "_pending" in str(f)]


def test_sink_in_queries(spark, tmp_path):
    spark.dataSource.register(lines.LinesSink)
    rows = spark.range(20).selectExpr("id", "cast(null as string) as none", "array(id) as ids", "timestamp_seconds(id) as at")
    out = ndjson.as_json(rows, "at").repartition(3)
    out.write.format("lines").option("path", str(tmp_path / "b")).mode("append").save()
    assert sorted(json.loads(v)["id"] for v in values(tmp_path / "b")) == list(range(20))
    out.filter("value like '%:1,%'").write.format("lines").option("path", str(tmp_path / "b")).mode("overwrite").save()
    assert len(values(tmp_path / "b")) == 1
    with pytest.raises(Exception, match="(?i)divi"):
        spark.range(9).selectExpr("cast(1 / (id - 8) as string) as value").write.format("lines").option("path", str(tmp_path / "b")).mode("append").save()
    assert len(values(tmp_path / "b")) == 1 and spark.read.text(str(tmp_path / "b")).count() == 1
    out.write.mode("overwrite").text(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        stream.writeStream.format("lines").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(json.loads(v)["id"] for v in values(tmp_path / "s")) == list(range(20))
