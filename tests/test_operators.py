"""Operators on small tables: edge cases that the driver tables don't have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks, columns, registry
from tessella.operators import analogy, components, encode, features, images, metrics
from tessella.sources import images as src
from tessella.sources import problems

IMAGE = "img_id long, h int, w int, pixels array<int>"
ENC = "encoding_id long, domain1 long, domain2 long, range_img long, grid int"


def table(spark, *pics):
    return spark.createDataFrame([(i, len(p), len(p[0]), [v for r in p for v in r]) for i, p in enumerate(pics)], IMAGE)


def noise(seed, h=8, w=8, values=(0, 128, 255)):
    return np.random.default_rng(seed).choice(values, (h, w)).tolist()


WHITE = [[255] * 8 for _ in range(8)]


def test_thresholds(spark):
    df = table(spark, *[[[v]] for v in (0, 127, 128, 129, 255)])
    got = df.orderBy("img_id").select(columns.not_white(F.col("pixels")).alias("a"), (columns.whitespace_area(F.col("pixels")) == 0).alias("b")).collect()
    assert [r.a for r in got] == [True, True, True, False, False]
    assert [r.b for r in got] == [True, False, False, False, False]


def brute(domain, rng, g, n_ti=10):
    """One-source codes by plain loops."""
    d, r = np.array(domain), np.array(rng)
    cand = []
    for sx in range(0, d.shape[0] // g * g, g):
        for sy in range(0, d.shape[1] // g * g, g):
            t = d[sx : sx + g, sy : sy + g]
            if (t <= 128).any():
                cand += [(sx, sy, ti, blocks.transform(t[None], ti)[0].astype(int)) for ti in range(n_ti)]
    if not cand:
        return None
    far = np.hypot((r.shape[0] // g - 1) * g - min(c[0] for c in cand), (r.shape[1] // g - 1) * g - min(c[1] for c in cand))
    out = {}
    for dx in range(0, r.shape[0] // g * g, g):
        for dy in range(0, r.shape[1] // g * g, g):
            t = r[dx : dx + g, dy : dy + g]
            err = [np.sqrt((((c[3] - t) ** 2) % 256 if c[2] != 9 else (c[3] - t) ** 2).sum()) + np.sqrt((dx - c[0]) ** 2 + (dy - c[1]) ** 2) / (far + 10) for c in cand]
            out[dx, dy] = cand[int(np.argmin(err))][:3]
    return out


@pytest.mark.parametrize("h,w,g", [(8, 8, 4), (9, 7, 3), (10, 6, 2)])
def test_encode_matches_loops(spark, h, w, g):
    a, b = noise(1, h, w), noise(2, h, w)
    e = spark.createDataFrame([(5, 0, None, 1, g), (6, 0, None, 1, g)], ENC)
    got = encode.encode(e, table(spark, a, b)).collect()
    want = brute(a, b, g)
    for i in (5, 6):
        assert {(r.dx, r.dy): (r.sx, r.sy, r.ti) for r in got if r.encoding_id == i} == want


def test_encode_edges(spark):
    pics = table(spark, WHITE, noise(3), [[0] * 3] * 3, noise(4, 5, 9))
    rows = [(0, 0, None, 1, 4), (1, 1, None, 1, 4), (2, 1, None, 2, 4), (3, 99, None, 1, 4), (4, 0, 1, 1, 4), (5, 1, None, 3, 4)]
    got = encode.encode(spark.createDataFrame(rows, ENC), pics, details=True).collect()
    by = lambda i: [r for r in got if r.encoding_id == i]
    assert [(r.sx, r.sy, r.ti, r.brightness, r.comp) for r in by(0)] == [(0, 0, 0, 255, 0)] * 4  # blank domain
    assert all((r.dx, r.dy, 0) == (r.sx, r.sy, r.ti) and r.err == 0 for r in by(1))  # an image encodes itself
    assert not by(2) and not by(3)  # grid too large; image unknown
    assert len(by(4)) == 4 and {r.src for r in by(4)} <= {1, 2}
    assert len(by(5)) == 2  # remainders dropped
    with pytest.raises(ValueError):
        encode.encode(spark.createDataFrame(rows, ENC), pics, error_mode="other")


def test_work_units_do_not_change_codes(spark, monkeypatch):
    pics = table(spark, noise(1), noise(2))
    e = spark.createDataFrame([(1, 0, None, 1, 2)], ENC)
    want = sorted(encode.encode(e, pics).collect())
    monkeypatch.setattr(encode, "UNIT_CANDIDATES", 1)
    assert sorted(encode.encode(e, pics).collect()) == want


def test_decode(spark):
    pics = table(spark, noise(1, 9, 9), noise(2, 9, 9))
    e = spark.createDataFrame([(1, 0, None, 1, 4)], ENC)
    s = pics.where("img_id = 0").select(F.lit(1).cast("long").alias("encoding_id"), "h", "w", F.struct("h", "w", "pixels").alias("source1"), F.lit(None).cast("struct<h:int,w:int,pixels:array<int>>").alias("source2"))
    got = {r.step: np.array(r.pixels).reshape(9, 9) for r in encode.decode(encode.encode(e, pics), s, 3).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[3][8:] == 255).all() and (got[3][:, 8:] == 255).all()
    assert (got[0] == np.array(noise(1, 9, 9))).all()
    clipped = encode.decode(encode.encode(e, pics), s, 1, clip=True).where("step = 1").first()
    assert max(clipped.pixels) <= 255 and min(clipped.pixels) >= 0


def test_features(spark):
    codes = spark.createDataFrame([(1, 4, 0, 0, 4, 6, 0.75, -239, 3, 4)], encode.CODE)
    got = [r.feature for r in features.features(codes).collect()]
    assert len(got) == 11
    tr = "id=0_angle=0_hf=0_vf=0_ryx=1_rynx=0_fill=0_unfill=0"
    assert got[0] == f"feat_spec_dx=4_dy=0_sx=0_sy=4_{tr}_brightness=(-240, -220)_img_comp=3_grid_size=4"
    assert got[1].startswith("pos_ag_dx=4_dy=-4_") and got[9].startswith("feat_pos_abs_dx=4_dy=4_")
    a, b = (spark.createDataFrame(x, "k int, feature string") for x in ([(1, "x"), (1, "y")], [(1, "y"), (2, "z")]))
    assert sorted(map(tuple, features.similarity(a, b, "k").collect())) == [(1, 0.5), (2, 0.0)]
    assert features.similarity(a.limit(0), b.limit(0), "k").count() == 0


def test_bins(spark):
    df = spark.createDataFrame([(b,) for b in (-255, -240, -239, 0, 1, 220, 221, 255)], "b int")
    got = [r.x for r in df.select(columns.brightness_bin(F.col("b")).alias("x")).collect()]
    assert got == ["(-255, -240)", "(-255, -240)", "(-240, -220)", "(-20, 0)", "(0, 20)", "(200, 220)", "(220, 255)", "(220, 255)"]


def test_analogy(spark):
    pics = table(spark, *[noise(i, 4, 4, (0, 255)) for i in range(9)])
    probs, figs = problems.from_images(pics)
    s = analogy.scores(problems.analogies(probs, ["A:B::A:B", "A:B::C:1", "A:B:C::A:B:C"]), figs, pics, 2).collect()
    by = {r.analogy: r.score for r in s}
    assert by["A:B::A:B"] == 1.0 and by["A:B:C::A:B:C"] == 1.0 and 0 <= by["A:B::C:1"] < 1
    with pytest.raises(Exception, match="two or three"):
        analogy.scores(problems.analogies(probs, ["A::B"]), figs, pics, 2).collect()


def test_images(spark):
    pics = table(spark, noise(5, 5, 7), noise(6, 5, 7))
    px = src.explode_pixels(pics)
    assert sorted(src.implode_pixels(px).collect()) == sorted(pics.collect())
    filled = {(r.img_id, r.y, r.x): r.v for r in images.fill(px).collect()}
    for i in (0, 1):
        want = blocks.fill(np.array([noise(5 + i, 5, 7)]))[0]
        assert all(filled[i, y, x] == want[y, x] for y in range(5) for x in range(7))
    moved = {r.img_id: r.pixels for r in images.translate(pics, -2, 1, 9).collect()}
    assert moved[0] == blocks.translate(np.array([noise(5, 5, 7)]), -2, 1, 9)[0].ravel().tolist()
    kinds = [images.filtered(pics, k).count() for k in ("fill", "unfill", "edges", "identity")]
    assert kinds == [2] * 4 and images.blur(pics).count() == 2
    with pytest.raises(ValueError):
        images.chosen_transforms(angle=45)
    assert images.chosen_transforms(270, fill=2) == ["Rotate270", "Identity", "Identity", "Identity", "Identity", "ShapeFiller"]
    labels = components.label_components(pics)
    assert components.neighbour_labels(labels).count() == 70
    both = images.pairs(pics)
    assert metrics.ssim(both).count() == 1 and images.compose(both, "ImageXOR").count() == 1
    with pytest.raises(ValueError):
        images.compose(both, "Nothing")


def test_empty_tables(spark):
    none = spark.createDataFrame([], IMAGE)
    e = spark.createDataFrame([], ENC)
    assert encode.encode(e, none).count() == 0
    assert images.tiles(none, 4).count() == 0 and images.reduce(none, 2).count() == 0
    assert components.label_components(none).count() == 0
    assert src.mosaics(none).count() == 0
    assert encode.chunks(none.select("img_id"), "img_id", 3).count() == 0


def test_codebook_file_and_stream(spark, tmp_path):
    from tessella.streaming.encode import encode_stream

    pics = table(spark, noise(1), noise(2))
    e = spark.createDataFrame([(1, 0, None, 1, 4)], ENC)
    codes = encode.encode(e, pics)
    src.write_codebook(codes, str(tmp_path / "book"))
    assert sorted(src.read_codebook(spark, str(tmp_path / "book")).collect()) == sorted(codes.collect())
    e.write.parquet(str(tmp_path / "in"))
    q = encode_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), pics, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_read_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, rows):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + bytes(r) for r in rows)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    folder = tmp_path / "pics"
    folder.mkdir()
    png(folder / "a.png", [[0, 128, 255], [3, 200, 77]])
    (folder / "b.png").write_bytes(b"no image")
    got = src.read_images(spark, str(folder)).collect()
    assert len(got) == 1 and (got[0].h, got[0].w, got[0].pixels) == (2, 3, [0, 128, 255, 3, 200, 77])


def test_write_images_and_read_them_back(spark, tmp_path):
    import time

    big = np.random.default_rng(3).integers(0, 256, (1000, 1000))
    pics = table(spark, noise(1, 5, 3), [[-1, 256], [300, 7]]).union(spark.createDataFrame([(7, 1000, 1000, big.ravel().tolist())], IMAGE))
    folder = str(tmp_path / "out")
    src.write_images(pics, folder)
    src.write_images(pics, folder)  # again: the same files
    start = time.time()
    got = {r.origin.rsplit("/", 1)[1]: (r.h, r.w, r.pixels) for r in src.read_images(spark, folder).collect()}
    assert time.time() - start < 10
    assert got["0.png"] == (5, 3, [v for r in noise(1, 5, 3) for v in r])
    assert got["1.png"] == (2, 2, [255, 0, 44, 7])  # as a cast to an unsigned byte has it
    assert got["7.png"] == (1000, 1000, big.ravel().tolist())
    empty = spark.createDataFrame([(1, 0, 0, []), (2, 0, 0, None)], IMAGE)
    assert [r.content for r in src.to_png(empty, "h").collect()] == [None, None]


@pytest.mark.parametrize("units", [1, 2_000, 10**9])
def test_units_are_spread_and_carry_their_own_rows(spark, monkeypatch, units):
    """Whatever a unit holds, codes are the same; one pair of images is dealt out as units."""
    pics = table(spark, noise(1, 22, 18), noise(2, 22, 18), noise(3, 22, 18))
    e = spark.createDataFrame([(1, 0, None, 1, 4), (2, 0, 2, 1, 3), (3, 1, None, 2, 5)], ENC)
    monkeypatch.setattr(encode, "UNIT_CANDIDATES", 10**12)
    want = sorted(encode.encode(e, pics).collect())
    monkeypatch.setattr(encode, "UNIT_CANDIDATES", units)
    assert sorted(encode.encode(e, pics).collect()) == want
    if units == 1:
        one = encode.encode(e.where("encoding_id = 1").withColumn("carry", F.lit(0)), pics, carry=True)
        parts = one.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one pair, all of the cluster


def test_carried_columns_stand_with_every_code(spark):
    pics = table(spark, noise(1), noise(2), WHITE)
    e = spark.createDataFrame([(1, 0, None, 1, 4, ("x", [("a", 1)])), (2, 2, None, 1, 4, ("y", []))], ENC + ", carry struct<n:string,l:array<struct<s:string,k:int>>>")
    got = encode.encode(e, pics, carry=True).collect()
    assert {(r.encoding_id, r.carry.n, tuple(map(tuple, r.carry.l))) for r in got} == {(1, "x", (("a", 1),)), (2, "y", ())} and len(got) == 8


def test_registry(spark):
    a, b = noise(5, 4, 6), noise(6, 4, 6)
    pics = table(spark, a, b)
    t = registry.translation(1, -2)
    assert (t.name, t.complexity, str(t)) == ("Translation", 3, "Translation(tx=1, ty=-2)")
    assert registry.translation(0, 0) == t and t != registry.TRANSFORMS["Identity"]
    assert registry.text(["Rotate90", t]) == "Compose(Rotate90()Translation(tx=1, ty=-2))" and registry.complexity(["Rotate90", t]) == 4
    got = images.chain(pics, ["Rotate90", t]).where("img_id = 0").first()
    want = blocks.translate(np.rot90(np.array([a]), 1, (1, 2)), 1, -2, 1)[0]
    assert (got.h, got.w, got.pixels) == (6, 4, want.ravel().tolist())
    own = registry.register_transform(registry.Transform("Negative", 2, lambda x: 255 - x))
    registry.register_composition("ImageMean", lambda x, y: (x + y) // 2)
    try:
        for f in (lambda: registry.register_transform(own), lambda: registry.register_composition("ImageUnion", max), lambda: registry.forget("Rotate90"), lambda: registry.forget("ImageUnion")):
            with pytest.raises(ValueError):
                f()
        assert images.chain(pics, ["Negative"]).where("img_id = 0").first().pixels == [255 - v for r in a for v in r]
        mean = images.compose(images.pairs(pics), "ImageMean").first().pixels
        assert mean == ((np.array(a) + np.array(b)) // 2).ravel().tolist()
    finally:
        registry.forget("Negative")
        registry.forget("ImageMean")
    with pytest.raises(KeyError):
        images.chain(pics, ["Negative"])


def test_repeated_cells(spark):
    cells = spark.range(3)
    assert sorted(map(tuple, images.repeated(cells, 2).collect())) == [(i, k) for i in range(3) for k in range(2)]
    assert images.repeated(cells, 0).count() == 0


def test_maps_have_the_scores_as_means(spark):
    both = images.pairs(table(spark, noise(1, 13, 13), noise(2, 13, 13)))
    whole = np.array(metrics.cw_ssim_map(both, 4).first().similarity)
    assert len(whole) == 169 and whole.mean() == pytest.approx(metrics.cw_ssim(both, 4).first().score)
    part = np.array(metrics.ssim_map(both).first().similarity).reshape(13, 13)[1:12, 1:12]
    assert blocks.ssim(np.array([noise(1, 13, 13)]), np.array([noise(2, 13, 13)]), 23)[0] == pytest.approx(part.mean())
