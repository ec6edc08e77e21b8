"""The CSV, Parquet and label edges."""

import pytest

from wayfold.sources import photos as P
from wayfold.streaming.sessions import stream_sessions

HEADER = ",".join(P.PHOTO_SCHEMA.names)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text(f'{HEADER}\nA-1,100,-25200,37.5,-122.25,TRUE,,0,"Make, Inc",,4032,3024\nA-2,,,,,,b,1,,,,\n')
    df = P.read_photos_csv(spark, str(tmp_path / "in.csv"))
    rows = {r.asset_id: r for r in df.collect()}
    assert rows["A-1"].is_screenshot and rows["A-1"].camera_make == "Make, Inc" and rows["A-2"].utc_epoch is None and not rows["A-2"].is_screenshot
    P.write_photos_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, P.read_photos_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.values()))
    df.write.parquet(str(tmp_path / "p"))
    assert P.read_photos_parquet(spark, str(tmp_path / "p")).count() == 2


def test_bad_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("asset_id,other\n1,2\n")
    with pytest.raises(ValueError):
        P.read_photos_csv(spark, str(tmp_path / "h.csv"))
    (tmp_path / "b.csv").write_text(f"{HEADER}\nA-1,1,0,,,maybe,,0,,,,\n")
    with pytest.raises(Exception, match="bad boolean"):
        P.read_photos_csv(spark, str(tmp_path / "b.csv")).collect()


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("label,start_date,end_date,place\n tahoe ,2024-01-01,2024-01-03, lake\n")
    row = P.read_labels_csv(spark, str(tmp_path / "l.csv")).first()
    assert (row.label, str(row.end_date), row.place) == ("tahoe", "2024-01-03", "lake")
    (tmp_path / "m.csv").write_text("label,start_date,end_date,place\nx,2024-01-04,2024-01-03,y\n")
    with pytest.raises(Exception, match="ends before"):
        P.read_labels_csv(spark, str(tmp_path / "m.csv")).collect()


def test_stream_session_boundaries(spark):
    for hours, n in (((10, 16), 1), ((10, 17), 2)):
        df = spark.createDataFrame([(1, h * 3600 + 5) for h in hours], "couple_id long, utc_epoch long")
        assert stream_sessions(df).count() == n
