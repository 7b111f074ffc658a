import numpy as np
import pytest

from changegrid.operators import augment


def _image(df, shape, value="value"):
    out = np.full(shape, np.nan)
    pdf = df.toPandas()
    out[pdf.row, pdf.col] = pdf[value]
    return out


@pytest.fixture()
def patch(pixels):
    img = np.random.default_rng(4).random((8, 8))
    return img, lambda pid: pixels(img).selectExpr(f"'{pid}' as patch_id", "row", "col", "value")


def test_flips_and_turns_are_those_of_numpy_and_shared_by_all_dates(patch):
    img, make = patch
    seen = set()
    for pid in range(12):
        df = make(pid)
        turned = _image(augment.rotate90(df, 8), (8, 8))
        k = [k for k in range(4) if np.array_equal(turned, np.rot90(img, k))]
        assert len(k) == 1
        flipped = _image(augment.flip(df, 8, 8), (8, 8))
        choice = [c for c, v in {"": img, "h": img[:, ::-1], "v": img[::-1], "hv": img[::-1, ::-1]}.items() if np.array_equal(flipped, v)]
        assert len(choice) == 1
        seen.add((k[0], choice[0]))
        label = augment.flip(df.selectExpr("patch_id", "row", "col", "value * 2 as value"), 8, 8)
        assert np.array_equal(_image(label, (8, 8)), flipped * 2)
    assert len(seen) > 4


@pytest.mark.parametrize("size", [3, 5])
def test_blur_mirrors_the_border(patch, size):
    img, make = patch
    k = np.array({3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[size]) / {3: 4, 5: 16}[size]
    pad = np.pad(img, size // 2, mode="reflect")
    rows = sum(w * pad[i : i + 8] for i, w in enumerate(k))
    want = sum(w * rows[:, i : i + 8] for i, w in enumerate(k))
    assert np.allclose(_image(augment.blur(make("p"), 8, 8, size=size), (8, 8)), want)


def test_crops(patch):
    img, make = patch
    assert np.array_equal(_image(augment.center_crop(make("p"), 8, 8, 4), (4, 4)), img[2:6, 2:6])
    got = _image(augment.random_crop(make("p"), 8, 8, 5), (5, 5))
    assert any(np.array_equal(got, img[r : r + 5, c : c + 5]) for r in range(4) for c in range(4))


def test_similarity_leaves_undrawn_patches_alone(patch):
    img, make = patch
    same = [np.allclose(_image(augment.shift_scale_rotate(make(p), 8, 8), (8, 8)), img) for p in range(8)]
    assert any(same) and not all(same)


def test_blur_is_drawn_once_per_patch(spark):
    rows = [(p, i, j, float((i * 7 + j * 3 + p) % 5)) for p in range(120) for i in range(6) for j in range(6)]
    px = spark.createDataFrame(rows, "patch_id int, row int, col int, value double")
    forms = [{(r.patch_id, r.row, r.col): round(r.value, 9) for r in f.collect()} for f in (px, augment.blur(px, 6, 6), augment.blur(px, 6, 6, size=5))]
    got = {(r.patch_id, r.row, r.col): round(r.value, 9) for r in augment.random_blur(px, 6, 6, epoch=3).collect()}
    assert got.keys() == forms[0].keys()
    kinds = [{p for p in range(120) if all(got[p, i, j] == f[p, i, j] for i in range(6) for j in range(6))} for f in forms]
    assert set.union(*kinds) == set(range(120)) and sum(map(len, kinds)) == 120
    assert len(kinds[0]) > 80 and kinds[1] and kinds[2]
