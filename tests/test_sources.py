"""In-memory sources and nested comparison."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions.compare import differences
from tessera.sources import memory


def test_images_and_footprints(spark):
    stacks = [np.arange(2 * 9).reshape(2, 3, 3), np.ones((1, 3, 3))]
    roi, image = memory.roi_images(spark, stacks)
    assert sorted(map(tuple, roi.collect())) == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    assert {r["roi_id"]: r["img"] for r in image.collect()}[0] == [float(v) for v in range(9)]
    with pytest.raises(ValueError, match="one size"):
        memory.roi_images(spark, [np.ones((1, 3, 3)), np.ones((1, 4, 4))])
    dense = memory.footprints(spark, [np.array([[[0, 1.0], [2.0, 0]]])])
    parts = memory.footprints(spark, [{"data": [1.0, 2.0], "indices": [1, 2], "indptr": [0, 2]}])
    assert sorted(map(tuple, dense.collect())) == sorted(map(tuple, parts.collect())) == [(0, 0, 1, 1.0), (0, 0, 2, 2.0)]


class Extractor:
    def get_roi_image_masks(self):
        return np.stack([np.eye(3), np.zeros((3, 3))], -1)


def test_adapters_and_scales(spark, tmp_path):
    assert memory.from_extractors(spark, [Extractor()]).count() == 3
    assert memory.sessions(spark, 2, 5, 6, 2.0).count() == 2
    with pytest.raises(ValueError, match="float"):
        memory.sessions(spark, 2, 5, 6, 2)
    np.save(tmp_path / "ops.npy", {"meanImg": np.zeros((4, 5)), "meanImgE": np.ones((2, 3)), "yrange": (1, 3), "xrange": (2, 5)}, allow_pickle=True)
    assert sum(memory.fov_from_ops(spark, [str(tmp_path / "ops.npy")]).first()["img"]) == 6
    found = memory.from_dict(spark, {"t": [{"a": 1, "b": "x"}]}, {"t": "a long, b string"})
    assert found["t"].collect() == [(1, "x")]
    with pytest.raises(KeyError):
        memory.from_dict(spark, {"u": []}, {"t": "a long"})
    memory.save_json({"b": [1, 2]}, str(tmp_path / "p.json"))
    assert memory.load_json(str(tmp_path / "p.json")) == {"b": [1, 2]}


def test_differences():
    a = {"x": [1.0, float("nan")], "y": {"z": np.array([1.0, 2.0])}, "_p": 1}
    assert differences(a, {"x": [1.0 + 1e-9, float("nan")], "y": {"z": np.array([1.0, 2.0])}, "_p": 2}) == []
    assert differences(a, {"x": [1.0], "y": {"z": np.array([1.0, 3.0]), "w": 0}}) == ["x: lengths 2 and 1", "y.w is on one side only", "y.z: arrays differ"]
