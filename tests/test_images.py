from __future__ import annotations

import pytest

from quarrymill.operators.images import image_documents

SCHEMA = "image int, nth int, kind string, detail string"


def documents(spark, parts):
    return {r["image"]: (r["document"] and r["document"].asDict(True), r["fault"]) for r in image_documents(spark.createDataFrame(parts, SCHEMA)).collect()}


def test_documents(spark):
    parts = [
        (1, 0, "image", "disk"), (1, 1, "volume_system", "table"), (1, 2, "volume", "boot"), (1, 3, "file_system", "fat"), (1, 4, "volume", "gap"), (1, 5, "volume", "data"), (1, 6, "file_system", "ext"),
        (2, 0, "image", "stick"), (2, 7, "file_system", "fat"),
        (3, 0, "image", "blank"),
        (None, 0, "image", None), (None, 3, "volume_system", "empty"),
    ]
    volumes = [{"detail": "boot", "file_system": {"detail": "fat"}}, {"detail": "gap", "file_system": None}, {"detail": "data", "file_system": {"detail": "ext"}}]
    assert documents(spark, parts[::-1]) == {
        1: ({"detail": "disk", "volume_system": {"detail": "table", "volumes": volumes}, "file_system": None}, None),
        2: ({"detail": "stick", "volume_system": None, "file_system": {"detail": "fat"}}, None),
        3: ({"detail": "blank", "volume_system": None, "file_system": None}, None),
        None: ({"detail": None, "volume_system": {"detail": "empty", "volumes": []}, "file_system": None}, None),
    }
    assert documents(spark, []) == {}


@pytest.mark.parametrize(
    ("kinds", "fault"),
    [
        (["volume"], "volume after nothing"), (["image", "image"], "image after image"), (["image", "volume"], "volume after image"),
        (["image", "file_system", "file_system"], "file_system after file_system"), (["image", "file_system", "volume"], "volume after file_system"),
        (["image", "volume_system", "file_system", "volume"], "file_system after volume_system"), (["image", "volume_system", "volume_system"], "volume_system after volume_system"),
        (["image", "volume_system", "volume", "volume_system"], "volume_system after volume"), (["image", None], "null after image"), (["image", "sector"], "sector after image"),
        (["image", "volume_system", "volume", "file_system", "file_system"], "file_system after file_system"),
    ],
)
def test_parts_out_of_order(spark, kinds, fault):
    assert documents(spark, [(1, i, k, "x") for i, k in enumerate(kinds)]) == {1: (None, fault)}
