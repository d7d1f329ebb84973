"""Readers, bridge, vocabularies, sources and the protocol on small fixtures."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sentria.functions import h3bits, h3cells, h3grid, shapes, sphere
from sentria.functions import text as T
from sentria.operators import bridge, point_reader, regions, role_reader, vocabulary
from sentria.plans import runtime
from sentria.schemas import EVIDENCE
from sentria.sources import ndjson, preview

WORDS = json.dumps({
    "version": "lexicon.v1",
    "kinds": {"drone": {"stems": ["шахед", "дрон"]}, "guided_bomb": {"stems": ["каб"]}, "cruise_missile": {"stems": ["крылат"]}, "ballistic_missile": {"stems": ["балл"]}, "missile": {"stems": ["ракет"]}},
    "cleared": {"stems": ["отбой", "чисто"], "negated_by": ["не"], "negated_after": ["нет"]}, "intercepted": {"forms": ["сбит", "сбиты"], "negated_by": ["не"]},
    "cues": {"target": ["на", "курс"], "via": ["через", "мимо"], "origin": ["из"]}, "conjunctions": ["и"], "fillers": ["город"], "continuation": {"leads": ["еще"], "marks": ["шум"]},
})
LEX = vocabulary.parse_lexicon(WORDS)


def place(i, word, within=None):
    return {"id": f"g:{i}", "name": word, "lat": 50.0 + i / 10, "lon": 30.0 + i / 10, "reach_km": 10, "match": {"stems": [word.lower()]}} | ({"within": within} if within else {})


GAZ = vocabulary.parse_role_gazetteer(json.dumps({"version": "gazetteer.v1", "attribution": "x", "places": [place(1, "Киев"), place(2, "Сумы"), place(3, "Оболонь", "g:1")]}))


def read_all(spark, texts):
    rows = role_reader.read(evidence(spark, *texts), LEX, GAZ).collect()
    own = lambda i: sorted((r for r in rows if r["external_id"] == f"x/{i}"), key=lambda r: r["statement"])
    return [own(i) for i in range(len(texts))]


READINGS = [
    ("2 дрона на Киев сейчас", [("drone", "threat", 2, [("g:1", "target")], False)]),
    ("Дроны через Сумы на Киев", [("drone", "threat", None, [("g:2", "via"), ("g:1", "target")], False)]),
    ("Дроны на Сумы и Киев", [("drone", "threat", None, [("g:2", "target"), ("g:1", "target")], False)]),
    ("Дроны из Сумы", [("drone", "threat", None, [("g:2", "origin")], False)]),
    ("Отбой на Киев", [(None, "cleared", None, [("g:1", "target")], False)]),
    ("Дрон не отбой на Киев", [("drone", "threat", None, [("g:1", "target")], False)]),
    ("3 дрона сбиты на Киев", [("drone", "intercepted", 3, [("g:1", "target")], False)]),
    ("Дроны. Еще на Сумы", [("drone", "threat", None, [], False), ("drone", "threat", None, [("g:2", "target")], True)]),
    ("Дроны: отбой. Еще на Сумы", [("drone", "cleared", None, [], False)]),
    ("5 минут дрон на Киев", [("drone", "threat", None, [("g:1", "target")], False)]),
    ("Баллистика, ракета на Киев", [("ballistic_missile", "threat", None, [("g:1", "target")], False)]),
    ("Дрон на Оболонь", [("drone", "threat", None, [], False)]),
    ("Дрон на Оболонь, Киев", [("drone", "threat", None, [("g:3", "target"), ("g:1", "target")], False)]),
    ("", []),
    ("Дроны из Сумы, Полтава, Киев", [("drone", "threat", None, [("g:2", "origin"), ("g:1", "mention")], False)]),
    ("Дроны на Сумы, Полтаву и Киев", [("drone", "threat", None, [("g:2", "target"), ("g:1", "target")], False)]),
    ("Дроны. 3 на Сумы. Дроны на Киев. 2 на Сумы", [("drone", "threat", None, [], False), ("drone", "threat", None, [("g:2", "target")], True), ("drone", "threat", None, [("g:1", "target")], False)]),
    ("Отбой, дроны на Киев", [(None, "cleared", None, [], False), ("drone", "threat", None, [("g:1", "target")], False)]),
]


def test_role_reader(spark):
    got = read_all(spark, [text for text, _ in READINGS])
    for (text, expected), rows in zip(READINGS, got, strict=True):
        assert [(r["kind"], r["phase"], r["count"], [(p["place_id"], p["role"]) for p in r["places"]], r["kind_inherited"]) for r in rows] == expected, text


def test_role_reader_keeps_repeated_posts_apart(spark):
    twice = evidence(spark, "Дрон на Сумы").unionByName(evidence(spark, "Дрон на Сумы")).unionByName(evidence(spark, None))
    assert [(r["statement"], len(r["places"])) for r in role_reader.read(twice, LEX, GAZ).collect()] == [(0, 1), (0, 1)]
    assert role_reader.read(twice.limit(0), LEX, GAZ).count() == 0
    assert role_reader.read(twice, LEX, vocabulary.RoleGazetteer([])).filter("size(places) > 0").count() == 0


def test_unresolved(spark):
    assert read_all(spark, ["Дрон на Полтаву"])[0][0]["unresolved"] == ["Полтаву"]


@pytest.mark.parametrize("change", [{"version": "lexicon.v2"}, {"extra": 1}])
def test_bad_lexicon(change):
    with pytest.raises(vocabulary.BadVocabulary):
        vocabulary.parse_lexicon(json.dumps(json.loads(WORDS) | change))


def test_tokens_agree(spark):
    texts = ["Дрон на Сумы, Киев. Отбой!", "об'єкт-2 – «слово»…", "a, b; c", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.role_tokens("t").alias("w")).collect()
    words = role_reader.split_words(evidence(spark, *texts)).orderBy("pos").collect()
    for i, row in enumerate(df):
        own = [w for w in words if w["external_id"] == f"x/{i}"]
        assert [(w["original"], w["folded"], w["barrier_before"], w["comma_before"]) for w in row["w"]] == [(w["text"], w["plain"], n == 0 or w["sentence"] > own[n - 1]["sentence"], w["after_comma"]) for n, w in enumerate(own)]
    lines = spark.createDataFrame([(t,) for t in texts], "t string").select(T.point_tokens("t").alias("w")).collect()
    for row, text in zip(lines, texts, strict=True):
        assert [(w["raw"], w["norm"], w["clause"]) for w in row["w"]] == point_reader.words_of(text)


def evidence(spark, *texts, forwarded=None):
    from datetime import datetime

    return spark.createDataFrame([("f:x", f"x/{i}", datetime(2024, 1, 1), False, t, [], forwarded, ("u", "c")) for i, t in enumerate(texts)], EVIDENCE)


def test_bridge(spark):
    r = role_reader.read(evidence(spark, "3 дрона сбиты на Киев", "Отбой", "Дрон на Сумы"), LEX, GAZ)
    rows = bridge.bridge(r).collect()
    assert sorted((x["stance"], x["count"], x["ttl"], x["provenance"]["place_id"]) for x in rows) == [("neutralized", 3, 600, "g:1"), ("threat", None, 1800, "g:1"), ("threat", None, 1800, "g:2")]
    assert all(len(x["geometry"]["rings"][0]) == 49 for x in rows)
    assert [tuple(x) for x in bridge.skipped(r).collect()] == [("x/1", "unlocated_clear")]
    assert bridge.bridge(role_reader.read(evidence(spark, "Дрон на Сумы", forwarded="y"), LEX, GAZ)).count() == 0


def test_bridge_says_what_it_cannot_place(spark):
    def at(i, **more):
        return place(i, f"Место{i}") | more

    gaz = vocabulary.parse_role_gazetteer(json.dumps({"version": "gazetteer.v1", "attribution": "x", "places": [at(1, id="ua-adm1:UA1"), at(2, id="ua-adm1:UA2"), at(3, lat=95.0), at(4, id="ua-adm1:UA3"), at(5)]}))
    r = role_reader.read(evidence(spark, *(f"Дрон на Место{i}" for i in range(1, 6))), LEX, gaz)
    known = spark.createDataFrame([("ua-adm1:UA1", 6, ["8611e1a27ffffff"]), ("ua-adm1:UA3", 6, ["8611e1a27ffffff"] * 5001)], "id string, resolution int, cells array<string>")
    seen, problems = bridge.bridge_all(r, known)
    assert sorted(x["provenance"]["evidence_id"] for x in seen.collect()) == ["x/0", "x/4"]
    assert sorted(map(tuple, problems.collect())) == [("x/1", "unknown_region"), ("x/2", "invalid_geometry"), ("x/3", "cover_too_large")]


NAMES = {T.keyed(["киев"]): {"place": {"id": "k", "name": "Киев", "lat": 50.0, "lon": 30.0}}, T.keyed(["сумы"]): {"place": {"id": "s", "name": "Сумы", "lat": 51.0, "lon": 34.0}}, T.keyed(["новое"]): {"place": None}}


@pytest.mark.parametrize(("line", "expected"), [
    ("2 дрона на Киев сейчас", [("air.attack_drone", "threat", 2, "k")]),
    ("Реактивный дрон, ракета на Киев", [("air.attack_drone", "threat", None, "k"), ][:0] + [("air.missile", "threat", None, "k")]),
    ("Ракета на Киев. Минус", [("air.missile", "clear", None, "k")]),
    ("Ракеты на Киев, шахеды на Сумы", [("air.missile", "threat", None, "k"), ("air.attack_drone", "threat", None, "s")]),
    ("Сумы: ракета", [("air.missile", "threat", None, "s")]),
    ("Шахед, Сумский район", []),
])
def test_point_reader(line, expected):
    pairs, _ = point_reader.read_line(line, NAMES)
    assert [(p["kind"], p["stance"], p["count"], p["place"]["id"]) for p in pairs] == expected


def test_point_reader_problems(spark):
    assert point_reader.read_line("Ракета на Новое", NAMES)[1] == [("ambiguous", "Новое"), ("unlocated", "air.missile")]
    rows, skipped = point_reader.observe(evidence(spark, "Шахед на Киев\nтихо"), NAMES)
    assert rows.count() == 1 and skipped.count() == 0


def test_namesakes(spark):
    rows = [("a", "Нова", 1.0, 1.0, "PPL", 20000, ""), ("b", "Нова", 2.0, 2.0, "PPL", 900, ""), ("c", "Липа", 1.0, 1.0, "PPL", 1000, ""), ("d", "Липа", 1.0, 1.0, "PPL", 1200, "")]
    names = vocabulary.resolved_names(vocabulary.point_names(spark.createDataFrame(rows, vocabulary.POINT_COLUMNS)))
    got = {r["key"]: (r["place"] and r["place"]["id"], r["ambiguous"]) for r in names.collect()}
    assert got[T.keyed(["нова"])[0]] == ("a", False) and got[T.keyed(["липа"])[0]] == (None, True)


@pytest.mark.parametrize(("lat", "lon", "cell"), [(37.7759387, -122.4183075, "8928308280fffff"), (37.3615593, -122.0553238, "85283473fffffff"), (40.689167, -74.044444, "8a2a1072b59ffff"), (79.2423985, 38.0234070, "8001fffffffffff")])
def test_published_cells(lat, lon, cell):
    number = h3grid.parsed(cell)
    assert h3grid.cell_of(lon, lat, h3grid.resolution_of(number)) == number and h3grid.text_of(number) == cell


@pytest.mark.parametrize("resolution", [0, 1, 2])
def test_the_grid_covers_the_world(resolution):
    cells = [c for b in range(122) for c in h3grid.children_of(h3grid._made(b, []), resolution)]
    assert len(cells) == 2 + 120 * 7**resolution and sum(map(h3grid.is_pentagon, cells)) == 12
    for c in cells:
        around = h3grid.neighbours(c)
        assert h3grid.cell_of(*h3grid.center_of(c), resolution) == c and len(around) == 6 - h3grid.is_pentagon(c) and all(c in h3grid.neighbours(n) for n in around)
        assert resolution == 0 or h3grid.parent_of(c, resolution - 1) in {h3grid.parent_of(n, resolution - 1) for n in around} | {h3grid.parent_of(c, resolution - 1)}
    assert abs(sum(map(h3grid.area_km2, cells)) / 510_065_622 - 1) < 1e-5


def test_positions_lie_in_their_cells():
    rnd = random.Random(1)
    for _ in range(3000):
        lat, lon, r = math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180), rnd.randint(0, 15)
        c = h3grid.cell_of(lon, lat, r)
        assert h3grid.parsed(h3grid.text_of(c)) == c and shapes._km((lon, lat), h3grid.center_of(c)) < 1.2 * h3grid.mean_edge_km(r)


@pytest.mark.parametrize("text", ["", "x", "8928308280ffff", "8928308280ffff7", "0928308280fffff", "89f5308280fffff", "8009fffffffffffff", "810847fffffffff".replace("847", "847"[:2] + "1")])
def test_no_cells(text):
    with pytest.raises(h3grid.NotACell):
        h3grid.parsed(text)


def test_cells_on_columns(spark):
    df = spark.createDataFrame([(30.5, 50.4), (None, 1.0), (10.0, 95.0)], "lon double, lat double").withColumn("cell", h3cells.cell_of("lon", "lat", F.lit(6)))
    rows = df.withColumn("c", h3cells.center_of("cell")).withColumn("up", h3bits.to_text(h3bits.up(F.col("cell")))).withColumn("kids", F.transform(h3bits.split(F.col("cell")), h3bits.to_text)).collect()
    cell = h3grid.cell_of(30.5, 50.4, 6)
    assert [r["cell"] for r in rows] == [cell, None, None] and abs(rows[0]["c"]["lon"] - h3grid.center_of(cell)[0]) < 1e-9
    assert rows[0]["up"] == h3grid.text_of(h3grid.parent_of(cell, 5)) and rows[0]["kids"] == [h3grid.text_of(c) for c in h3grid.children_of(cell, 7)]


def test_polygons():
    ring = shapes.around(30.5238, 50.4547, 20, 48)
    made = shapes.polygon([ring], 6, 400)
    assert 25 < len(made) < 60 and all(shapes._km((30.5238, 50.4547), h3grid.center_of(c)) < 20 for c in made)
    assert {c for c in h3grid.disk(made, 2) if shapes._inside([ring], *h3grid.center_of(c))} == made
    hole = shapes.around(30.5238, 50.4547, 10, 48)
    assert shapes.polygon([ring, hole], 6, 400) == made - shapes.polygon([hole], 6, 400)
    assert shapes.polygon([shapes.around(30.5238, 50.4547, 0.1, 48)], 6, 400) == {h3grid.cell_of(30.5238, 50.4547, 6)}
    assert len(shapes.covered({"type": "cells", "cells": [h3grid.text_of(c) for c in made], "resolution": 6}, 7, 400)) == 7 * len(made)


def test_regions(spark, tmp_path):
    own = [h3grid.text_of(c) for c in shapes.polygon([shapes.around(30.5, 50.4, 30, 48)], 6, 400)]
    coarse = h3grid.text_of(h3grid.cell_of(30.5, 50.4, 4))
    region = lambda i, resolution, cells: {"id": f"ua-adm1:{i}", "name": "x", "lat": 50.4, "lon": 30.5, "reach_km": 30, "resolution": resolution, "cells": cells}
    (tmp_path / "r.json").write_text(json.dumps({"version": "regions.v1", "attribution": "x", "regions": [region(1, 6, own), region(2, 6, [coarse, "8609a4d07ffffff"]), region(3, 5, [coarse]), region(4, 6, ["zz"]), region(5, 3, [coarse])]}))
    rows, problems = regions.load_regions(spark, str(tmp_path / "r.json"))
    assert {r["id"]: len(r["cells"]) for r in rows.collect()} == {"ua-adm1:1": len(own), "ua-adm1:2": 50, "ua-adm1:3": 7}
    assert {r["id"] for r in problems.collect()} == {"ua-adm1:4", "ua-adm1:5"}
    packed = regions.compacted(rows.select("id", F.explode("cells").alias("t")).withColumn("cell", h3bits.parse(F.col("t"))), "id", 3)
    assert {r["id"]: r["n"] for r in packed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}["ua-adm1:2"] == 2


def test_corridor_and_limits():
    a, b = (30.5, 50.4), (31.3, 51.5)
    there, back = sphere.corridor_ring(a, 10, b, 20), sphere.corridor_ring(b, 20, a, 10)
    assert shapes.polygon([there], 6, 3000) == shapes.polygon([back], 6, 3000)
    assert sphere.corridor_ring(a, 10, (90.0, 50.0), 10) is None
    with pytest.raises(shapes.Refused):
        shapes.polygon([[(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)]], 12, 1000)


def test_corridor_as_an_expression(spark):
    """The column against the hull of both discs' corners: apart, one within the other, the same, along and across, at the date line."""
    rnd = random.Random(9)
    ends = [((30.5, 50.4), 10.0, (31.3, 51.5), 20.0), ((30.5, 50.4), 10.0, (30.5, 50.4), 40.0), ((30.5, 50.4), 10.0, (30.5, 50.4), 10.0), ((0.0, 0.0), 5.0, (3.0, 0.0), 5.0), ((10.0, -20.0), 5.0, (10.0, -17.0), 25.0), ((179.95, 5.0), 15.0, (179.0, 5.5), 30.0)]
    ends += [((rnd.uniform(-170, 170), rnd.uniform(-70, 70)), rnd.uniform(1, 90), (0.0, 0.0), rnd.uniform(1, 90)) for _ in range(30)]
    ends = [(a, r, b if i < 6 else (a[0] + rnd.uniform(-3, 3), a[1] + rnd.uniform(-3, 3)), s) for i, (a, r, b, s) in enumerate(ends)] + [((30.5, 50.4), 10.0, (90.0, 50.0), 10.0), ((30.5, 50.4), 0.0, (31.0, 50.0), 10.0)]
    df = spark.createDataFrame([(n, *map(float, a), r, *map(float, b), s) for n, (a, r, b, s) in enumerate(ends)], "n int, x double, y double, r double, u double, v double, s double")
    got = df.select("n", sphere.corridor("x", "y", F.col("r"), "u", "v", F.col("s")).alias("ring")).orderBy("n").collect()
    for row, (a, r, b, s) in zip(got, ends, strict=True):
        plain = sphere.corridor_ring(a, r, b, s)
        assert (row["ring"] is None) == (plain is None)
        if plain:
            ring = [(p["lon"], p["lat"]) for p in row["ring"]]
            assert ring[0] == ring[-1] and abs(len(ring) - len(plain)) <= 2
            # corners on a line, to rounding, may be left out by one of them
            near = lambda p, others: min(abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in others) < 0.02
            assert all(near(p, plain) for p in ring) and all(near(p, ring) for p in plain)
            assert shapes.polygon([ring], 6, 9000) == shapes.polygon([plain], 6, 9000)


def message(post, body="", extra="", cls="", when="2024-01-01T10:00:00+03:00"):
    return f'<div class="tgme_widget_message {cls}" data-post="{post}">{extra}{body and f"<div class=js-message_text>{body}</div>"}<span class="tgme_widget_message_meta"><time datetime="{when}"></time></span></div>'


PAGE = '<a class="tme_messages_more" data-before="101"></a><section class="tgme_channel_history">' + message("chan1/100", cls="service_message") + message("chan1/103", "b", '<a class="tgme_widget_message_photo_wrap" style="background-image:url(\'https://x/p.jpg\')"></a>') + message("chan1/101", "one<br/>two &amp; <b>x</b>  ") + message("chan1/106", extra='<div class="message_media_not_supported"></div>') + "</section>"


def test_preview_page():
    page = preview.parse_preview("chan1", PAGE)
    assert page.ids == [101, 103, 106] and page.older == 101
    first, second, third = page.evidence
    assert first["text"] == "one\ntwo & x" and first["published_at"].hour == 7 and first["forwarded_from"] is None
    assert second["media"] == [{"kind": "photo", "url": "https://x/p.jpg"}] and third["media"] == [{"kind": "other", "url": None}] and third["text"] is None
    with pytest.raises(preview.SourceError, match="not_found"):
        preview.parse_preview("chan1", "<p>nothing</p>")


def post(number, body, channel="chan1", more=""):
    return f'<div class="{preview.MESSAGE}" data-post="{channel}/{number}">{more}<div class="{preview.BODY}">{body}</div><span class="{preview.META}"><time datetime="2024-01-01T00:00:00Z"></time></span></div>'


@pytest.mark.parametrize(("body", "text"), [
    ("three </b> x", "three  x"), ("a <b>b <i>c</b> d</i> e", "a b c d e"), ("a <i>b", "a b"), ("a </p></nav></span> b", "a  b"), ("<p>a<p>b</p>", "ab"), ("<b>a<div>b</b>c</div>d", "abcd"),
    ("<ul><li>a<li>b</ul>c", "abc"), ("a<br/>b<br>c</br>d", "a\nb\ncd"), ("<a href=x>a<a href=y>b</a>c", "abc"), ("<span>a<div>b</span>c</div>d", "abcd"), ("a <img src=x></img> b", "a  b"), ("a <div/>b</div> c", "a b c"),
])
def test_repaired_markup(body, text):
    page = preview.parse_preview("chan1", f'<section class="{preview.HISTORY}">' + post(1, "one") + post(2, body) + post(3, "last </i>") + "</section>")
    assert [(i, e["text"]) for i, e in zip(page.ids, page.evidence, strict=True)] == [(1, "one"), (2, text), (3, "last")]


def test_messages_that_are_not_closed():
    """What follows belongs to the open message as well; what comes first in it counts."""
    open_ = post(1, "one").removesuffix("</div>")
    media = '<a class="tgme_widget_message_photo_wrap" style="background-image:url(\'https://x/2.jpg\')"></a>'
    forward = f'<a class="{preview.FORWARDED}">Some <b>name</a> more'
    page = preview.parse_preview("chan1", f'<section class="{preview.HISTORY}">' + open_ + post(2, "two", more=media + forward) + "</section>" + post(4, "four"))
    first, second, last = page.evidence
    assert (first["text"], second["text"], last["text"]) == ("one", "two", "four") and first["media"] == second["media"] == [{"kind": "photo", "url": "https://x/2.jpg"}]
    assert first["forwarded_from"] == second["forwarded_from"] == "Some name" and last["forwarded_from"] is None and last["media"] == []


def test_media_classes_in_their_order():
    both = '<div class="tgme_widget_message_document_wrap tgme_widget_message_video_player"><video src="https://x/v.mp4"></video></div>'
    page = preview.parse_preview("chan1", f'<section class="{preview.HISTORY}">' + post(1, "one", more=both) + "</section>")
    assert page.evidence[0]["media"] == [{"kind": "video", "url": "https://x/v.mp4"}]


def test_preview_paging_and_source(spark, tmp_path):
    (tmp_path / "chan1.html").write_text(PAGE)
    (tmp_path / "chan1-before-101.html").write_text(PAGE.replace("/101", "/99").replace('data-before="101"', 'data-before="101"'))
    (tmp_path / "chan1-after-101.html").write_text(PAGE)
    (tmp_path / "chan1-after-106.html").write_text('<section class="tgme_channel_history"></section>')
    get = preview.folder_transport(str(tmp_path))
    assert [e["external_id"] for e in preview.backfill(get, "chan1")] == ["chan1/106", "chan1/103", "chan1/101", "chan1/99"]
    assert preview.poll(get, "chan1", 101)[1] == 106
    spark.dataSource.register(preview.PreviewSource)
    df = spark.read.format("preview").option("channels", "chan1").option("folder", str(tmp_path)).load()
    assert df.count() == 4
    waits = []
    limited = iter([(429, "", b""), (200, "https://t.me/s/chan1", b"ok")])
    assert preview.fetch(lambda url: next(limited), "chan1", sleep=waits.append) == "ok" and waits == [15]


def test_ndjson(spark, tmp_path):
    df = evidence(spark, "Дрон на Сумы", None)
    ndjson.write_evidence(df, str(tmp_path / "out"))
    assert ndjson.read_evidence(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.json").write_text('{"source_id": "f:x", "external_id": "x/1"}\n\nnope\n')
    assert ndjson.numbered_problems(spark, str(tmp_path / "bad.json")).count() == 1


def ask(operation, payload=None, version=runtime.PROTOCOL, spark=None, **more):
    return json.loads(runtime.handle(json.dumps({"protocol_version": version, "request_id": "r", "operation": operation} | ({"payload": payload} if payload is not None else {}) | more), runtime.Vocabulary(LEX, GAZ, NAMES, {}), spark))


def test_protocol(spark):
    assert ask("capabilities")["result"]["limits"]["evidence"] == 500
    assert json.loads(runtime.handle("{"))["failure"]["code"] == "invalid_request"
    assert ask("dance", version="x")["failure"]["code"] == "unknown_operation"
    assert ask("cover", {}, version="x")["failure"]["code"] == "unsupported_version"
    assert ask("cover", {"geometry": {"type": "point", "coordinates": [30, 50]}, "rings": 1})["result"]["cells"].__len__() == 7
    assert ask("cover", {"geometry": {"type": "point", "coordinates": [30, 50]}, "x": 1})["failure"]["code"] == "invalid_request"
    assert ask("normalize", {"evidence": [{}] * 501})["failure"]["code"] == "window_too_large"
    assert ask("assess", {"policy_version": "x", "evaluation_time": "2024-01-01T00:00:00Z", "observations": []})["failure"]["code"] == "unknown_policy"
    assert ask("assess", {"policy_version": "fusion.v1", "observations": []})["failure"]["code"] == "invalid_request"
    post = {"source_id": "f:x", "external_id": "x/1", "published_at": "2024-01-01T10:00:00+02:00", "provenance": {"url": "u", "collector": "c"}, "text": "2 дрона на Киев сейчас"}
    for reader in runtime.READERS:
        found = ask("normalize", {"evidence": [post], "reader": reader}, spark=spark)["result"]["observations"]
        assert found[0]["observed_at"] == "2024-01-01T08:00:00Z" and found[0]["count"] == 2
        out = ask("assess", {"policy_version": "fusion.v1", "evaluation_time": "2024-01-01T08:10:00Z", "observations": found})["result"]
        assert [a["status"] for a in out["assessments"]] == ["active"] and [e["kind"] for e in out["events"]] == ["issued"] and "tracks" not in out
        full = ask("assess", {"policy_version": "fusion.v1", "evaluation_time": "2024-01-01T08:10:00Z", "observations": found}, spark=spark)["result"]
        assert (full["assessments"], full["events"]) == (out["assessments"], out["events"])
        assert [(t["status"], t["first_at"], len(t["cells"]["cells"]) > 20) for t in full["tracks"]] == [("active", "2024-01-01T08:00:00Z", True)] * 2 and [e["kind"] for e in full["track_events"]] == ["started"] * 2
    whole = json.dumps({"protocol_version": runtime.PROTOCOL, "request_id": "w", "operation": "capabilities"}, indent=2)
    assert json.loads(runtime.handle_document(f"\n{whole}\n"))["request_id"] == "w"


def test_dumps_of_places(spark, tmp_path):
    import zipfile

    row = lambda i, cls="P", country="UA": "\t".join([str(i), f"N{i}", f"N{i}", "", "50", "30", cls, "PPL", country, "", "", "", "", "", "5000", "", "", "", "2024"])
    text = "\n".join([row(1), "2\tshort", row(3, "A"), row(4, country="PL"), row(5) + "\r", ""])
    (tmp_path / "d.txt").write_text(text)
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("UA.txt", text)
    for path in ("d.txt", "d.zip"):
        rows, problems = vocabulary.read_dump(spark, str(tmp_path / path))
        assert sorted((r["id"], r["modified"], r["population"]) for r in rows.collect()) == [(i, "2024", 5000) for i in "1345"]
        assert [r["value"] for r in problems.collect()] == ["2\tshort"]
    spec = spark.createDataFrame([(1, None, "a", None, 5), (5, None, "b", 9, None), (4, None, "c", None, None), (None, "UA1", "d", None, None), (None, "UA2", "e", None, None), (5, None, "b", None, 7)], "geonames_id long, region string, name string, reach_km int, within long")
    regions_ = spark.createDataFrame([("ua-adm1:UA1", 50.0, 30.0, 80)], "id string, lat double, lon double, reach_km int")
    got, problems = vocabulary.build_role_gazetteer(spec, rows, regions_)
    assert sorted((r["id"], r["reach_km"], r["within"]) for r in got.collect()) == [("geonames:1", 5, "geonames:5"), ("geonames:5", 5, "geonames:7"), ("geonames:5", 9, None), ("ua-adm1:UA1", 80, None)]
    assert sorted((r["id"], r["problem"].split()[0]) for r in problems.collect()) == [("geonames:4", "not"), ("geonames:5", "lies"), ("geonames:5", "listed"), ("ua-adm1:UA2", "not")]
