import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from changegrid.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def pixels(spark):
    """Array -> (scene_id, row, col, value) frame."""
    import numpy as np
    import pandas as pd

    def make(img, scene_id=0, value="value", **extra):
        img = np.asarray(img, float)
        r, c = np.indices(img.shape)
        pdf = pd.DataFrame({"scene_id": scene_id, "row": r.ravel(), "col": c.ravel(), value: img.ravel(), **extra})
        return spark.createDataFrame(pdf.astype({"scene_id": "int32", "row": "int32", "col": "int32"}))

    return make


@pytest.fixture()
def mask_of(spark):
    """Boolean array -> changed pixels (scene_id, row, col)."""
    import numpy as np
    import pandas as pd

    def make(img, scene_id=0):
        r, c = np.nonzero(np.asarray(img))
        pdf = pd.DataFrame({"scene_id": scene_id, "row": r, "col": c}).astype("int32")
        return spark.createDataFrame(pdf, "scene_id int, row int, col int")

    return make


@pytest.fixture()
def meta_of(spark):
    def make(rows):
        """rows: (scene_id, height, width[, affine of six, epsg])."""
        full = []
        for r in rows:
            affine = r[3] if len(r) > 3 else None
            epsg = r[4] if len(r) > 4 else None
            full.append((r[0], r[1], r[2], *(affine or (None,) * 6), epsg, "2023-01-01", "2024-01-01"))
        return spark.createDataFrame(
            full,
            "scene_id int, height int, width int, a double, b double, c double, d double, e double, f double, epsg int, t_a string, t_b string",
        )

    return make
