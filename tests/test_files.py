"""Salt, hashes, anchors, guards, library rows, and the commands on a folder."""

import os

import pytest

from wayfold.__main__ import main
from wayfold.sources import files, library
from wayfold.sources import photos as P


def test_salt_is_kept_and_checked(tmp_path):
    path = tmp_path / "in" / "salt.key"
    assert files.salt(path) == files.salt(path) and len(files.salt(path)) == 32 and os.stat(path).st_mode & 0o77 == 0
    path.write_bytes(b"short")
    with pytest.raises(ValueError):
        files.salt(path)


def test_guards(tmp_path):
    files.write_own(tmp_path, {"a": b"1", "b": b"2"})
    files.write_own(tmp_path, {"a": b"3"})
    (tmp_path / "a").write_bytes(b"edited")
    with pytest.raises(files.Refused):
        files.write_own(tmp_path, {"a": b"4", "b": b"5"})
    assert (tmp_path / "b").read_bytes() == b"2"
    files.write_own(tmp_path, {"a": b"4"}, force=True)
    assert files.fresh(tmp_path / "none", []) == (False, "not run") and files.fresh(tmp_path / "a", [tmp_path / "b"])[0]
    os.utime(tmp_path / "a", (1, 1))
    assert not files.fresh(tmp_path / "a", [tmp_path / "b"])[0]


def test_hash_files(spark, tmp_path):
    one, two = "ab" * 16, "0c" * 16
    files.write_hashes(spark.createDataFrame([(1, one), (1, two), (1, one)], "couple_id long, hash string"), str(tmp_path / "h"))
    assert sorted(r.hash for r in files.read_hashes(spark, str(tmp_path / "h"), 7).collect()) == [two, one]
    (tmp_path / "bad.txt").write_text("xyz\n")
    with pytest.raises(Exception, match="not a hash"):
        files.read_hashes(spark, str(tmp_path / "bad.txt"), 7).collect()


def test_anchor_files(spark, tmp_path):
    row = {"couple_id": 4, "person": "a", "home_geohash7": "9q8yvcx", "home_lat": 37.7612341, "home_lon": -122.44, "home_days": 17, "work_geohash7": None, "work_lat": None, "work_lon": None, "work_days": 0, "window_days": 90, "shared_home": None}
    for shared in (None, True, False):
        (tmp_path / "a.toml").write_text(files.anchors_toml({**row, "shared_home": shared}))
        assert files.read_anchors(spark, [tmp_path / "a.toml"]).first().asDict() == {**row, "home_lat": 37.761234, "shared_home": shared}
    (tmp_path / "a.toml").write_text(files.anchors_toml(row) + "shared_home = 1\n")
    with pytest.raises(ValueError):
        files.read_anchors(spark, [tmp_path / "a.toml"])


def test_library_rows(spark):
    schema = "uuid string, date timestamp, tz_offset_s int, lat double, lon double, screenshot boolean, uti string, hidden boolean, shared boolean, burst boolean, burst_selected boolean, burst_members array<string>, camera_make string, camera_model string, width int, height int"
    from datetime import datetime, timezone

    t = datetime(2024, 1, 1, 0, 0, 0, 900000, tzinfo=timezone.utc)
    row = lambda u, **k: tuple({"uuid": u, "date": t, "tz_offset_s": 0, "lat": None, "lon": None, "screenshot": False, "uti": "public.jpeg", "hidden": False, "shared": False, "burst": False, "burst_selected": False, "burst_members": None, "camera_make": "M", "camera_model": "", "width": 1, "height": 2, **k}.values())
    rows = [row("a"), row("b", hidden=True), row("c", shared=True), row("d", uti="public.png", camera_make=""), row("e", uti="public.png"), row("z", burst=True, burst_members=["y", "x"])]
    got = {r.asset_id: r for r in library.from_library(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == ["a", "d", "e", "z"] and got["a"].utc_epoch == 1704067200 and got["a"].camera_model is None
    assert [got[k].is_screenshot for k in "ade"] == [False, True, False] and got["z"].burst_id == "x"
    exported = spark.createDataFrame([(1, 91.0, 0.0, 3600, 0), (1, 1.0, 2.0, 3601, 60), (None, 1.0, 2.0, 900, 0), (1, None, 2.0, 54000, 7)], "utc_epoch long, lat double, lon double, own_offset_s int, phone_offset_s int")
    got = [(r.lat, r.lon, r.tz_offset_s) for r in library.as_exported(exported).collect()]
    assert got == [(None, None, 3600), (1.0, 2.0, 60), (1.0, 2.0, None), (None, None, 7)]


def test_text_cells_keep_blanks(spark, tmp_path):
    (tmp_path / "in.csv").write_text(",".join(P.PHOTO_SCHEMA.names) + '\n" x",1,0,,, true ,,0,,,,\n')
    r = P.read_photos_csv(spark, str(tmp_path / "in.csv")).first()
    assert r.asset_id == " x" and r.is_screenshot
    P.write_photos_parquet(P.read_photos_csv(spark, str(tmp_path / "in.csv")), str(tmp_path / "p"))
    assert P.read_photos_parquet(spark, str(tmp_path / "p")).first() == r


def test_commands(spark, tmp_path, capsys):
    call = lambda *a: main([*a, "--data", str(tmp_path)], spark)
    for command in ("synth", "ingest", "filter", "buckets", "match", "anchors", "trips", "report"):
        assert call(command) == 0, command
    out = capsys.readouterr().out
    assert "hashes in common" in out and "a: one home" in out and "sweep: not run" in out and "6 trips" in out
    assert "| Detected trips | 6 |" in (tmp_path / "report.md").read_text()
    (tmp_path / "anchors_a.toml").write_text((tmp_path / "anchors_a.toml").read_text() + "# by hand\n")
    assert call("anchors") == 1 and call("anchors", "--force") == 0
    (tmp_path / "a_photos.csv").write_text("asset_id\n1\n")
    assert call("ingest") == 2 and call("synth") == 1
