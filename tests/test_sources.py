import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.sources import readers, sinks
from dendroframe.streaming import ingest

P = "tree_id string, point_id long, x double, y double, z double"


@pytest.fixture()
def xyz():
    return np.random.default_rng(0).normal(size=(50, 3))


def test_cloud_formats(spark, tmp_path, xyz):
    np.save(tmp_path / "3_1_a.npy", xyz)
    np.save(tmp_path / "3_2_flat.npy", xyz.ravel())
    np.savetxt(tmp_path / "3_3_b.txt", xyz)
    np.savetxt(tmp_path / "3_4_c.txt", xyz, delimiter=",")
    (tmp_path / "3_5_d.las").write_bytes(readers.encode_las(xyz))
    (tmp_path / "3_6_e.laz").write_bytes(b"broken")
    df = readers.read_clouds(spark, f"file://{tmp_path}")
    n = {r.tree_id: r["count"] for r in df.filter("error is null").groupBy("tree_id").count().collect()}
    assert n == {f"3_{i}": 50 for i in range(1, 6)}
    assert df.filter("error is not null").select("tree_id").first()[0] == "3_6"
    las = np.array([tuple(r) for r in df.filter("tree_id = '3_5'").orderBy("point_id").select("x", "y", "z").collect()])
    assert np.abs(las - xyz).max() <= 0.0006
    wide = readers.read_clouds(spark, f"file://{tmp_path}", "*.npy", 11)
    assert wide.first().height == 0.0 and "extra" not in wide.columns


def test_round_trip_through_sinks(spark, tmp_path, xyz):
    df = spark.createDataFrame([("3_1", i, *map(float, r)) for i, r in enumerate(xyz)], P)
    for kind in ("npy", "txt", "las", "other"):
        out = tmp_path / kind
        assert sinks.write_files(sinks.cloud_files(df, ["x", "y", "z"], kind), f"file://{out}") == 1
        back = readers.read_clouds(spark, f"file://{out}").orderBy("point_id").select("x", "y", "z").collect()
        assert np.abs(np.array([tuple(r) for r in back]) - xyz).max() <= 0.0006


def test_cylinder_dialects(spark, tmp_path):
    (tmp_path / "3_1_qsm.csv").write_text(' "ID", start.x ,start.y,start.z,endX,endY,endZ,Radius,BranchOrder\n1,0,0,0,0,0,1,0.5,0\n2,x,1,1,1,1,nan,0.25,1\n,,,,,,,,\n')
    df = readers.read_cylinders(spark, f"file://{tmp_path}")
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2} and rows[1].tree_id == "3_1" and rows[1].radius == 0.5
    assert rows[2].sx is None and rows[2].ez is None and rows[2].branch_order == 1
    with pytest.raises(ValueError, match="radius"):
        readers.resolve_columns(["ID", "startX", "startY", "startZ", "endX", "endY", "endZ"])


def test_json_and_config(spark, tmp_path):
    meta = {"3_1": {"path": "p", "rasters": [{"raster_id": 0, "bounds": {"min": [0, 0, 0], "max": [1, 1, 1]}}]}}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    t = readers.read_raster_metadata(spark, f"file://{tmp_path}/m.json")
    assert t.first().max_z == 1.0
    assert json.loads(sinks.raster_json(t).first().value)["rasters"][0]["bounds"]["max"] == [1, 1, 1]
    (tmp_path / "l.json").write_text('["a/3_1.npy", "b"]')
    assert readers.read_file_list(spark, f"file://{tmp_path}/l.json").count() == 2
    s = spark.createDataFrame([("test", "b"), ("test", "a")], "split string, path string")
    assert sinks.splits_json(s).first().value == '["a","b"]'
    (tmp_path / "c.yaml").write_text("stage2:\n  k_init: 7\n") if _has_yaml() else (tmp_path / "c.yaml").write_text('{"stage2": {"k_init": 7}}')
    assert readers.read_config(str(tmp_path / "c.yaml")) == {"stage2": {"k_init": 7}}


def _has_yaml():
    try:
        import yaml  # noqa: F401
    except ImportError:
        return False
    return True


def test_meshes(spark):
    v, f = sinks.cylinder_mesh(np.zeros(3), np.array([0, 0, 2.0]), 0.5, 64)
    a, b, c = (v[f[:, i]] for i in range(3))
    assert abs(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6) == pytest.approx(math.pi * 0.25 * 2, rel=0.01)
    c = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5), ("t", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1e-9), ("t", 2, 0.0, 0.0, float("nan"), 0.0, 0.0, 1.0, 0.5)], "tree_id string, id long, sx double, sy double, sz double, ex double, ey double, ez double, radius double")
    raw = bytes(sinks.mesh_files(c).first().content)
    assert raw.startswith(b"ply\n") and b"element face 48\n" in raw
    s = spark.createDataFrame([("t", 0.0, 0.0, 0.0, 1.0, True)], "tree_id string, x double, y double, z double, radius double, is_outer boolean")
    assert b"0 0 255" in bytes(sinks.sphere_files(s).first().content)


def test_cylinder_csv_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("3_1", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, 1.0, 1.0, None, [1], "follow")], "tree_id string, id long, sx double, sy double, sz double, ex double, ey double, ez double, radius double, volume double, length double, parent_id long, children_ids array<long>, type string")
    sinks.write_cylinder_csv(c, f"file://{tmp_path}/out")
    back = readers.standardise_cylinders(spark.read.option("header", True).csv(f"file://{tmp_path}/out")).first()
    assert back.radius == 0.5 and back.parent_id is None


def test_streaming_ingest(spark, tmp_path, xyz):
    src = tmp_path / "in"
    src.mkdir()
    np.save(src / "3_1.npy", xyz)
    q = ingest.running_extent(ingest.cloud_stream(spark, f"file://{src}")).writeStream.outputMode("complete").format("memory").queryName("extent").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        np.save(src / "3_2.npy", xyz[:10])
        (src / "3_3.npy").write_bytes(b"broken")
        q.processAllAvailable()
        assert {r.tree_id: r.n for r in spark.table("extent").collect()} == {"3_1": 50, "3_2": 10}
    finally:
        q.stop()


def test_npy_buffer():
    b = io.BytesIO()
    np.save(b, np.arange(6.0))
    assert readers.decode_npy(b.getvalue()).shape == (2, 3)
    assert F is not None
