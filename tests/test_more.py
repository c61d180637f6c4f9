"""Samples, settings, dataset kinds, uploads, previews, base64 images and the public names."""

import numpy as np
import pytest

import floorwright
from floorwright.functions import config
from floorwright.kernels import pixels as P
from floorwright.operators import augment, edits, tiles
from floorwright.sources import datasets, exports, readers


def test_weights_are_means():
    for source, target in ((7, 3), (3, 7), (5, 5), (1, 4), (10, 1)):
        assert np.allclose(P.weights(source, target).sum(1), 1)
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (P.resampled(image, 4, 4) == image).all()
    assert P.resampled(image, 2, 2)[0, 0].tolist() == [8, 9, 10]  # the mean of four pixels, 7.5 up
    assert P.nearest(np.arange(4).reshape(2, 2), 4, 2).tolist() == [[0, 1], [0, 1], [2, 3], [2, 3]]
    assert P.fitted(30, 90, 45) == (15, 45) and P.fitted(3, 4, 45) == (3, 4) and P.fitted(1, 900, 10) == (1, 10)
    assert P.padded(np.ones((2, 3), int), 3, 2, 9).tolist() == [[1, 1, 1], [1, 1, 1], [9, 9, 9]]


def test_samples_follow_their_seed(spark):
    r = np.random.default_rng(0)
    mask = np.zeros((90, 70), np.uint8)
    mask[20:60, 10:50] = r.integers(1, 5, (40, 40))
    image = np.repeat(mask[:, :, None] * 50, 3, 2)
    df = spark.createDataFrame([(k, 90, 70, bytearray(image.tobytes()), bytearray(mask.tobytes())) for k in range(4)], augment.PAIR)
    rule = augment.Augmentation(crop=64)
    one, two, other = ([bytes(x.mask) for x in augment.augmented(d, e, 3, rule).orderBy("plan_id").collect()] for d, e in ((df, 0), (df.repartition(3), 0), (df, 1)))
    assert one == two and one != other and len(set(one)) > 1
    assert all(len(m) == 64 * 64 for m in one)
    plain = augment.Augmentation(crop=64, light=(0, 0, 0), grey=0, tint=(0, 0), noise=(0, 0, 0))
    for seed in range(20):
        a, b = augment.sample(image, mask, seed, plain)
        assert a.shape == (64, 64, 3) and set(np.unique(b)) <= {0, 1, 2, 3, 4, 255}
        assert (a[b == 255] == augment.PAPER).all()
    small = augment.resized(df, 45, 32).first()
    assert (small.height, small.width) == (64, 64) and bytes(small.mask).count(255) == 64 * 64 - 45 * 35


def test_prediction_in_a_smaller_size(spark):
    image = np.zeros((60, 100, 3), np.uint8)
    image[:, 50:] = 255
    df = spark.createDataFrame([(1, 60, 100, bytearray(image.tobytes()))], "plan_id long, height int, width int, data binary")
    make = lambda: lambda x: np.stack([x.mean(1), -x.mean(1)], 1) * 9
    got = np.frombuffer(tiles.predict(df, make, tile=32, max_side=50).first().data, np.uint8).reshape(60, 100)
    assert (got[:, :46] == 1).all() and (got[:, 54:] == 0).all()


def test_settings():
    base = {"data": {"size": 512, "kinds": ["a"]}, "lr": 0.1, "name": None}
    got = config.settings(base, [{"data": {"size": 256}, "unknown": 1}], ["lr=1e-3", "data.kinds=[b, 2]", "name=x=y", "no.such.key=1"])
    assert got == {"data": {"size": 256, "kinds": ["b", 2]}, "lr": 0.001, "name": "x=y"}
    assert base["data"]["size"] == 512
    assert [config.scalar(t) for t in ("true", "~", "7", "-1.5", '{"a": 1}', "[]", "two words")] == [True, None, 7, -1.5, {"a": 1}, [], "two words"]


def test_kinds_of_datasets(spark, tmp_path):
    assert datasets.dataset(spark, "synthetic", plans=2, size=64).count() == 2
    (tmp_path / "a.svg").write_text('<svg><g class="Space Den"><polygon points="1,1 9,1 9,9 1,9"/></g></svg>')
    row = datasets.dataset(spark, "drawings", path=str(tmp_path), height=12, width=12).first()
    assert bytes(row.data).count(2) == 81
    with pytest.raises(ValueError, match="unknown kind"):
        datasets.dataset(spark, "web")


def test_uploads(spark, tmp_path, monkeypatch):
    (tmp_path / "good.png").write_bytes(exports.png(np.zeros((3, 3, 3), np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"no image at all")
    (tmp_path / "big.png").write_bytes(exports.png(np.random.default_rng(0).integers(0, 255, (60, 60, 3))))
    monkeypatch.setattr(readers, "MOST", 5000)
    got = {r.path.rpartition("/")[2]: (r.status, r.content is not None) for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got == {"good.png": (200, True), "bad.png": (400, False), "big.png": (413, False)}


def test_base64_images():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (4, 6, 3), (3, 3, 4)):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (exports.from_png(exports.png_text(a)) == a).all()
    with pytest.raises(ValueError, match="no PNG"):
        exports.from_png(b"GIF89a")


def test_preview_is_not_kept():
    h = edits.History().commit()
    shown = h.preview()
    assert (shown.version, shown.versions) == (h.fresh, h.versions)
    assert shown.undo().version == 0 and shown.redo().version == h.version
    assert shown.commit() == h.commit()


def test_public_names():
    assert all(callable(getattr(floorwright, n)) or n == "TAXONOMIES" for n in floorwright.__all__)
    with pytest.raises(AttributeError):
        floorwright.nothing  # noqa: B018


def test_views_show_the_image_where_they_say():
    """Without changes of colour a sample is the image through its view; a whole turn of a plan that fills it loses nothing."""
    still = augment.Augmentation(crop=32, scale=(1, 1), light=(0, 0, 0), grey=0, tint=(0, 0), blur=(0, 0, 0), noise=(0, 0, 0))
    mask = np.arange(32 * 32).reshape(32, 32).astype(np.uint8) % 200 + 1
    image = np.repeat((mask // 2)[:, :, None], 3, 2)
    seen = set()
    for seed in range(60):
        a, b = augment.sample(image, mask, seed, still)
        turns = [np.rot90(m, k) for m in (mask, mask[:, ::-1]) for k in range(4)]
        (which,) = [k for k, t in enumerate(turns) if (t == b).all()]
        seen.add(which)
    assert seen == set(range(8))
    far = augment.Augmentation(crop=16, scale=(1.4, 1.4), on_plan=1.0)
    small = np.zeros((90, 90), np.uint8)
    small[80, 7] = 3
    assert all((augment.sample(np.zeros((90, 90, 3), np.uint8), small, seed, far)[1] == 3).any() for seed in range(30))
    changed = augment.Augmentation(crop=24, blur=(1.0, 1.0, 1.0), light=(0, 0, 0), grey=0, tint=(0, 0), noise=(0, 0, 0))
    a, b = augment.sample(np.full((10, 10, 3), 100, np.uint8), np.ones((10, 10), np.uint8), 1, changed)
    assert (a[b == 1] == 100).all() and (a[b == 255] == 255).all()


def test_small_images_are_scored_on_a_whole_tile():
    sizes = []

    def score(x):
        sizes.append(x.shape[2:])
        return np.stack([x.mean(1), -x.mean(1)], 1)

    assert tiles.probabilities(np.zeros((20, 90, 3), np.uint8), score, tile=64).shape == (2, 20, 90)
    assert set(sizes) == {(64, 64)}
