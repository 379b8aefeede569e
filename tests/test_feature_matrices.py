"""Matrices with different headers in one scan."""

import pytest

from fieldhush.sources.tables import read_feature_matrices


def test_headers_of_their_own(spark, tmp_path):
    (tmp_path / "am1_feature_matrix.csv").write_text('clip_name,x,clip_label\nAudio_Moth_1_20250318_181418.wav,1.5,1\n"odd, name",,0\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "AM2_feature_matrix.csv").write_text('clip_label,"clip_name",y,sim_type\n0,b,2,Vehicle\n1,c,oops,"a, b"\n')
    folder = tmp_path / "am3_feature_matrix.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"clip_name,x\n{'pqr'[i]},{i}\n")
    (tmp_path / "am4_full_feature_matrix.csv").write_text("clip_name,x\nno,9\n")
    (tmp_path / "notes.csv").write_text("clip_name,x\nno,9\n")
    got = read_feature_matrices(spark, str(tmp_path)).collect()
    rows = {(r.clip_name, r.recorder, r.x, r.y, r.clip_label, r.sim_type) for r in got}
    assert rows == {("Audio_Moth_1_20250318_181418.wav", "AM1", 1.5, None, 1.0, None), ("odd, name", "AM1", None, None, 0.0, None), ("b", "AM2", None, 2.0, 0.0, "Vehicle"),
                    ("c", "AM2", None, None, 1.0, "a, b"), *(("pqr"[i], "AM3", float(i), None, None, None) for i in range(3))}
    assert len(got) == 7
    with pytest.raises(FileNotFoundError):
        read_feature_matrices(spark, str(tmp_path / "sub"), name=r"am(\d+)_other\.")


def test_parquet(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)], "clip_name string, x double").write.parquet(str(tmp_path / "am1_feature_matrix.parquet"))
    spark.createDataFrame([("b", 2.0)], "clip_name string, y double").write.parquet(str(tmp_path / "am5_feature_matrix.parquet"))
    got = {(r.clip_name, r.recorder, r.x, r.y) for r in read_feature_matrices(spark, str(tmp_path), "parquet").collect()}
    assert got == {("a", "AM1", 1.0, None), ("b", "AM5", None, 2.0)}
