import json
import sys
import threading
from collections import Counter
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from helpers import config
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skywait.plans import stages
from skywait.sources import catalogue_items, search, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fetcher goes to workers
AOIS = ("berlin", "paris", "rome")


class Files:
    """Pages over files of items, one folder an entity; every call leaves a note, and chosen ones fail twice."""

    def __init__(self, root, size=3, failing=""):
        self.root, self.size, self.failing = str(root), size, failing

    def _items(self, aoi):
        found = [json.loads(p.read_text()) for p in Path(self.root, aoi).glob("*.json")]
        return sorted(found, key=lambda i: (i["properties"]["datetime"], i["id"]))

    def page(self, aoi, start, end, token):
        at = int(token or 0)
        notes = Path(self.root, "notes")
        key = f"{aoi}~{start[:10]}~{at}".replace(":", "")
        seen = len(list(notes.glob(f"{key}~*")))
        (notes / f"{key}~{seen}").touch()
        if key == self.failing and seen < 2:
            raise OSError("try again")
        mine = [i for i in self._items(aoi) if search.instant(start) <= search.instant(i["properties"]["datetime"]) <= search.instant(end)]
        return mine[at : at + self.size] + ["no item"], str(at + self.size) if at + self.size < len(mine) else None

    def newest(self, aoi):
        found = self._items(aoi)
        return found[-1]["properties"]["datetime"] if found else None


def put(root, aoi, name, at, sequence=0):
    folder = Path(root, aoi)
    folder.mkdir(parents=True, exist_ok=True)
    Path(root, "notes").mkdir(exist_ok=True)
    item = {
        "id": name, "collection": "c", "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "assets": {},
        "properties": {"datetime": at.isoformat() + "Z", "grid:code": f"MGRS-{aoi}", "s2:datatake_id": f"T{at:%Y%m%d}", "s2:sequence": str(sequence), "s2:generation_time": "2025-06-26T12:06:04Z"},
    }
    (folder / f"{name}.json").write_text(json.dumps(item))


def asked(root):
    return Counter(tuple(p.name.split("~")[:2]) for p in Path(root, "notes").iterdir())


def year(root, aois=AOIS):
    for a in aois:
        for k in range(24):
            put(root, a, f"{a}-{k:02d}", datetime(2025, 1, 1) + timedelta(days=15 * k))


def read(spark, name, **options):
    return spark.read.format(name).options(**({"entities": json.dumps(AOIS), "start": "2025-01-01", "end": "2025-12-31T23:59:59"} | options)).load()


def test_chunks():
    at = search.instant
    parts = search.chunks("a", at("2024-01-01"), at("2024-12-31T23:59:59"))
    assert len(parts) == 5 and parts[-1].end == at("2024-12-31T23:59:59") and all(b.start - a.end == timedelta(seconds=1) for a, b in zip(parts, parts[1:], strict=False))
    assert search.chunks("a", at("2024-01-02"), at("2024-01-01")) == [] and len(search.chunks("a", at("2024-01-01"), at("2024-01-01"))) == 1


def test_filters_prune_partitions(spark, tmp_path):
    year(tmp_path)
    name = search.register(spark, Files(tmp_path), "pruned")
    everything = read(spark, name)
    assert everything.rdd.getNumPartitions() == 3 * 5 and everything.count() == 72 and len(asked(tmp_path)) == 15
    for p in Path(tmp_path, "notes").iterdir():
        p.unlink()
    some = read(spark, name).where("aoi_id = 'paris' and datetime >= timestamp '2025-03-20' and datetime < timestamp '2025-05-20'")
    want = {f"paris-{k:02d}" for k in range(24) if datetime(2025, 3, 20) <= datetime(2025, 1, 1) + timedelta(days=15 * k) < datetime(2025, 5, 20)}
    assert {r.id for r in some.collect()} == want and len(want) == 4
    assert {a for a, _ in asked(tmp_path)} == {"paris"} and len(asked(tmp_path)) == 2, "two chunks of one entity"
    assert {r.aoi_id for r in read(spark, name).where(F.col("aoi_id").isin("rome", "oslo")).collect()} == {"rome"}


def test_a_page_that_fails_twice_is_read(spark, tmp_path):
    year(tmp_path, ("paris",))
    name = search.register(spark, Files(tmp_path, failing="paris~2025-01-01~3"), "failing", pause=lambda _: None)
    rows = read(spark, name, entities='["paris"]')
    assert rows.count() == 24 and len(list(Path(tmp_path, "notes").glob("paris~2025-01-01~3~*"))) == 3
    pages = [(r.page, r.place) for r in rows.orderBy("datetime").collect()]
    assert pages == sorted(pages), "the order in which items came"
    year(tmp_path / "other", ("paris",))
    strict = search.register(spark, Files(tmp_path / "other", failing="paris~2025-04-01~0"), "strict", pause=lambda _: None)
    with pytest.raises(Exception, match="try again"):
        read(spark, strict, entities='["paris"]', tries="1").count()


def test_discovery_from_the_source(spark, tmp_path):
    root, data = tmp_path / "in", str(tmp_path / "data")
    year(root)
    name = search.register(spark, Files(root), "fed")
    cfg = config(aois=AOIS, data_dir=data, start=date(2025, 1, 1), end=date(2025, 12, 31))
    first = {r.aoi_id: r.new for r in stages.discover(spark, cfg, stages.searched(name), data, now=datetime(2026, 1, 1)).collect()}
    assert first == dict.fromkeys(AOIS, 24)
    for p in Path(root, "notes").iterdir():
        p.unlink()
    put(root, "rome", "rome-late", datetime(2025, 12, 10))
    again = {r.aoi_id: (r.fetched, r.new) for r in stages.discover(spark, cfg, stages.searched(name), data, now=datetime(2026, 1, 2)).collect()}
    assert again["rome"] == (2, 1) and {d for _, d in asked(root)} == {"2025-12-05"}, "from the watermark less seven days on"


def content(spark, data):
    return {t: sorted(map(str, tables.read_or_empty(spark, data, t).collect())) for t in ("scenes", "scene_aoi", "scenes_superseded", "ingest_state")}


def test_a_stream_that_stops_gives_the_tables_of_one_run(spark, tmp_path):
    root, now = tmp_path / "in", datetime(2026, 1, 1)
    cfg = config(aois=AOIS, start=date(2025, 1, 1), end=date(2025, 12, 31))
    name = search.register(spark, Files(root), "flow")
    steps = [lambda: year(root, AOIS[:2]), lambda: (put(root, "paris", "paris-new", datetime(2025, 12, 20)), put(root, "paris", "paris-late", datetime(2025, 12, 11)), year(root, AOIS[2:])), lambda: put(root, "berlin", "berlin-23b", datetime(2025, 12, 12, 10), 3)]
    for step in steps:
        step()
        for _ in range(2):  # the second start finds nothing new
            q = stages.discover_stream(spark, cfg, str(tmp_path / "a"), str(tmp_path / "cp"), name, now=now)
            q.awaitTermination(240)
            assert q.exception() is None
    before = content(spark, str(tmp_path / "a"))
    newest = max((int(p.name), p) for p in (tmp_path / "cp" / "commits").glob("*[0-9]"))[1]
    newest.unlink()  # as if the query had died in its last batch: it is read and merged again
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    stages.discover_stream(spark, cfg, str(tmp_path / "a"), str(tmp_path / "cp"), name, now=now).awaitTermination(240)
    assert content(spark, str(tmp_path / "a")) == before
    stages.discover(spark, cfg, stages.searched(name), str(tmp_path / "b"), now=now)
    assert content(spark, str(tmp_path / "b")) == before
    assert len(before["scenes"]) == 74 and len(before["scenes_superseded"]) == 1


def test_pages_over_http(spark, tmp_path, capsys):
    from skywait import cli

    items = [{"id": f"i{k}", "properties": {"datetime": f"2025-02-{k + 1:02d}T00:00:00Z"}, "geometry": {"type": "Polygon", "coordinates": [[[13, 52], [14, 52], [14, 53], [13, 52]]]}, "collection": "c", "assets": {}} for k in range(7)]
    bodies = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bodies.append(body)
            newest = "sortby" in body
            at, n = body.get("token", 0), body["limit"]
            found = items[::-1][:1] if newest else items[at : at + n]
            links = [] if newest or at + n >= len(items) else [{"rel": "next", "method": "POST", "href": f"http://127.0.0.1:{server.server_port}/search", "body": {"token": at + n}}]
            out = json.dumps({"type": "FeatureCollection", "features": found, "links": links}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        shape = {"type": "Point", "coordinates": [1, 2]}
        fetcher = search.HttpFetcher(f"http://127.0.0.1:{server.server_port}/search", "c", {"a": shape}, limit=3)
        assert fetcher.newest("a") == "2025-02-07T00:00:00Z"
        bodies.clear()
        rows = spark.read.format(search.register(spark, fetcher, "web")).options(entities='["a"]', start="2025-02-01", end="2025-02-28").load().collect()
        first = list(bodies)
        (tmp_path / "c.csv").write_text("aoi_id,name,country,lat,lon\nberlin,Berlin,Germany,52.52,13.405\n")
        (tmp_path / "c.yaml").write_text(f"start: 2025-01-01\nend: 2025-06-30\naois: [berlin]\ndata_dir: {tmp_path / 'data'}\n")
        address = f"http://127.0.0.1:{server.server_port}/search"
        assert cli.main(["discover", address, "--config", str(tmp_path / "c.yaml")]) == 2, "entities come first"
        assert cli.main(["aois", str(tmp_path / "c.csv"), str(tmp_path / "data")]) == 0
        assert cli.main(["discover", address, "--config", str(tmp_path / "c.yaml")]) == 0
        assert tables.read_or_empty(spark, str(tmp_path / "data"), "scenes").count() == 7
        assert bodies[-1]["intersects"]["type"] == "Polygon" and len(bodies[-1]["intersects"]["coordinates"][0]) == 5
        bodies[:] = first
    finally:
        server.shutdown()
    assert sorted(r.id for r in rows) == [i["id"] for i in items] and len(bodies) == 3
    assert all(b["intersects"] == shape and b["collections"] == ["c"] and b["datetime"].startswith("2025-02-01T00:00:00+00:00/") for b in bodies)


def test_items_of_the_source_are_those_of_files(spark, tmp_path):
    year(tmp_path, ("rome",))
    rows = read(spark, search.register(spark, Files(tmp_path), "like"), entities='["rome"]')
    got = catalogue_items.parsed(rows.drop("datetime"), "item")
    features = [json.loads(p.read_text()) for p in (tmp_path / "rome").glob("*.json")]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    want = catalogue_items.read_items(spark, str(tmp_path / "all.json"))
    assert set(got.columns) == {*want.columns, "aoi_id"}
    same = [c for c in want.columns if c not in ("page", "place", "geometry_json", "geometry")]
    assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.select(*same).collect()))
