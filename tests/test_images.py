import struct
import zlib

import os

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lumirank.functions import pixels
from lumirank.operators import embedding, preprocess, validate
from lumirank.plans import ingest
from lumirank.sources import collection, images

TIME = "2024-01-01 00:00:00"


def png(array):
    """PNG bytes of an (h, w, c) byte array with 1, 3 or 4 channels."""
    h, w, c = array.shape
    raw = b"".join(b"\x00" + array[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def solid(h, w, colour):
    return np.tile(np.array(colour, np.uint8), (h, w, 1))


SOLIDS = {
    "rgb.png": (solid(40, 60, (200, 100, 50)), (200, 100, 50)),
    "rgba.png": (solid(60, 40, (10, 20, 250, 255)), (10, 20, 250)),
    "gray.png": (solid(50, 50, (77,)), (77, 77, 77)),
    "portrait.png": (solid(300, 100, (1, 2, 3)), (1, 2, 3)),
    "landscape.png": (solid(260, 500, (255, 0, 128)), (255, 0, 128)),
    "exact.png": (solid(224, 224, (9, 8, 7)), (9, 8, 7)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for name, (array, _) in SOLIDS.items():
        (root / name).write_bytes(png(array))
    (root / "broken.png").write_text("no image at all")
    return str(root)


def normalized(colour):
    return (np.array(colour) / 255.0 - pixels.MEAN) / pixels.STD


def test_solid_images_have_closed_form_tensors(spark, folder):
    out = preprocess.preprocess_images(images.with_image_path(images.read_images(spark, folder)))
    assert "data" not in out.schema["image"].dataType.names
    got = {r["image_path"].rsplit("/", 1)[-1]: r for r in out.collect()}
    assert set(got) == {*SOLIDS, "broken.png"}
    for name, (array, colour) in SOLIDS.items():
        tensor = np.array(got[name]["tensors"]).reshape(3, 224, 224)
        assert np.allclose(tensor, normalized(colour)[:, None, None], atol=1e-5), name
        assert (got[name]["image"]["height"], got[name]["image"]["width"]) == array.shape[:2]
    assert got["broken.png"]["tensors"] is None and "not an image" in got["broken.png"]["error"]


def test_bad_images_are_split_off_or_dropped_at_the_source(spark, folder):
    out = preprocess.preprocess_images(images.read_images(spark, folder), size=8)
    good, bad = validate.split_rejects(out)
    assert good.count() == len(SOLIDS)
    assert [r["reason"] for r in bad.collect()] == ["missing tensors"]
    assert images.read_images(spark, folder, drop_invalid=True).count() == len(SOLIDS)
    refused = preprocess.preprocess_images(images.read_images(spark, folder), size=8, gray="reject")
    assert refused.where("tensors is null").count() == 2


def test_pixels_are_stripped_in_field_order(spark, folder):
    image = images.strip_pixels(images.read_images(spark, folder)).schema["image"].dataType
    assert image.names == ["origin", "height", "width", "nChannels", "mode"]
    stamped = images.with_preprocess_time(images.read_images(spark, folder), F.lit(TIME).cast("timestamp"))
    assert stamped.select("preprocess_time").distinct().count() == 1


def slow_resize(image, size):
    """The same resampling written out pixel by pixel."""
    h, w, _ = image.shape
    new_h, new_w = pixels.target_size(h, w, size)

    def cubic(x):
        x = abs(x)
        if x < 1:
            return ((-0.5 + 2) * x - (-0.5 + 3)) * x * x + 1
        return (((x - 5) * x + 8) * x - 4) * -0.5 if x < 2 else 0.0

    def line(values, n_out):
        n_in, out = len(values), []
        scale = n_in / n_out
        stretch = max(scale, 1.0)
        for o in range(n_out):
            center = (o + 0.5) * scale
            lo, hi = max(int(center - 2 * stretch + 0.5), 0), min(int(center + 2 * stretch + 0.5), n_in)
            ws = [cubic((r - center + 0.5) / stretch) for r in range(lo, hi)]
            total = sum(ws)
            ks = [int(x / total * (1 << 22) + (0.5 if x >= 0 else -0.5)) for x in ws]
            out.append(min(255, max(0, (sum(int(v) * k for v, k in zip(values[lo:hi], ks)) + (1 << 21)) >> 22)))
        return out

    across = np.array([[line(image[y, :, c], new_w) for y in range(h)] for c in range(image.shape[2])])
    down = np.array([[line(across[c, :, x], new_h) for x in range(new_w)] for c in range(image.shape[2])])
    full = down.transpose(2, 1, 0).astype(np.uint8)
    top, left = round((new_h - size) / 2), round((new_w - size) / 2)
    return full[top : top + size, left : left + size]


@pytest.mark.parametrize("shape", [(30, 21, 3), (9, 17, 3), (16, 16, 1), (8, 8, 3), (8, 13, 3), (5, 40, 1)])
def test_resampling_equals_the_pixel_by_pixel_form(shape):
    image = np.random.default_rng(sum(shape)).integers(0, 256, shape, dtype=np.uint8)
    assert np.array_equal(pixels.resize_and_crop(image, 8), slow_resize(image, 8))


def test_transparent_pixels_do_not_bleed():
    image = solid(8, 8, (0, 0, 255, 255)).copy()
    image[:, 4:] = (255, 0, 0, 0)  # invisible red
    out = pixels.resize_and_crop(image, 4)
    assert out[..., 0].max() == 0


def test_there_and_back(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{i}", (f"p{i}", 56, 56, 3, 16, bytearray(rng.integers(0, 256, 56 * 56 * 3, dtype=np.uint8).tobytes()))) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, " + images.IMAGE_SCHEMA)
    tensors = preprocess.preprocess_images(df, size=56).withColumn("path", F.col("image.origin"))
    back = preprocess.tensor_to_image(tensors, size=56, origin="path")
    got = {r["id"]: np.frombuffer(bytes(r["image"]["data"]), np.uint8).astype(int) for r in back.collect()}
    for key, image in rows:
        assert np.abs(got[key] - np.frombuffer(bytes(image[5]), np.uint8)).max() <= 1
    assert back.schema["image"].dataType.names == df.schema["image"].dataType.names
    again = preprocess.preprocess_images(back.select("id", "image"), size=56)
    assert again.where("tensors is null").count() == 0


def test_normalised_columns_equal_the_tensor(spark):
    values = list(range(0, 256, 8))[:32]
    df = spark.createDataFrame([(values,)], "p array<int>")
    got = df.select(pixels.normalize_pixels(F.col("p"), 4)).first()[0]
    array = np.array(values, np.uint8).reshape(1, 8, 4)
    assert np.allclose(got, pixels.to_planes(array).ravel(), atol=1e-6)


def doubler(size):
    """A model giving twice the length of a text and the size of the batch it came in."""

    class Doubler(embedding.Embedder):
        dim = size

        def load(self):
            return lambda batch: np.array([[2.0 * len(text), len(batch)] for text in batch])

    return Doubler()


def test_texts_are_embedded_in_batches_and_in_order(spark):
    rows = [(i, None if i == 5 else "x" * i) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embedding.embed_texts(df, doubler(2)).collect()}
    assert got.pop(5) is None
    assert all(v[0] == 2.0 * i and v[1] <= 32 for i, v in got.items())


def test_a_model_of_the_wrong_shape_fails(spark):
    with pytest.raises(Exception, match="of dimension 3"):
        embedding.embed_texts(spark.createDataFrame([("a",)], "text string"), doubler(3)).collect()


def test_one_pass_equals_two(spark, folder):
    source = images.with_image_path(images.read_images(spark, folder))
    model = embedding.PooledImageEmbedder(32)
    two = embedding.embed_images(preprocess.preprocess_images(source), model)
    one = embedding.preprocess_and_embed(source, model)
    a = {r["image_path"]: r["embedding"] for r in two.collect()}
    b = {r["image_path"]: r["embedding"] for r in one.collect()}
    assert a == b and sum(v is None for v in a.values()) == 1


def test_hashed_text_counts(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT!"), (2, ""), (3, None)], "id int, text string")
    out = embedding.embed_texts(df, embedding.HashingTextEmbedder(64))
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert sum(got[1]) == 4.0 and sorted(v for v in got[1] if v) == [2.0, 2.0]
    assert sum(got[2]) == 0.0 and len(got[2]) == 64 and got[3] is None
    assert {r["n"] for r in embedding.sparse_counts(out, "id").collect()} == {2.0}


def test_images_to_answers(spark, folder, tmp_path):
    path, rejects = str(tmp_path / "c"), str(tmp_path / "rejects")
    model = embedding.PooledImageEmbedder(32)
    collection.ensure_collection(spark, path, 32)
    source = images.read_images(spark, folder)
    for _ in range(2):  # the second run replaces, it does not add
        ingest.ingest_images(spark, source, path, model, rejects_path=rejects, batch="b", time=F.lit(TIME).cast("timestamp"))
    rows = collection.read_collection(spark, path, collection.DEFAULT_NAMESPACE)
    assert {r["id"] for r in rows.select("id").collect()} == set(SOLIDS)
    from lumirank.operators.search import top_k

    q = rows.select(F.col("id").alias("name"), F.monotonically_increasing_id().alias("query_id"), F.col("values").alias("embedding"))
    found = top_k(q.select("query_id", "embedding"), rows, 1)
    assert found.count() == len(SOLIDS) and found.where("score < 0.999999").count() == 0
    assert spark.read.parquet(rejects).where("reason = 'missing embedding'").count() == 2


def test_image_directory_as_a_stream(spark, folder, tmp_path):
    stream = images.with_image_path(images.read_image_stream(spark, folder, drop_invalid=True))
    out = preprocess.preprocess_images(stream, size=8)
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "p"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == len(SOLIDS)


def test_both_forms_of_the_token_buckets_agree(spark):
    from lumirank.functions.text import SEPARATORS

    def token_buckets(text, dim):
        tokens = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")
        return F.transform(
            tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
        )

    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "x1", "İz", "K9", "naïve", "…", "--", "\n", "ß", "42"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(200)] + ["", " ", "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    dense = embedding.embed_texts(df, embedding.HashingTextEmbedder(32)).withColumn("b", token_buckets(F.col("text"), 32))
    for row in dense.collect():
        assert row["embedding"] == np.bincount(row["b"], minlength=32).tolist()


def test_a_model_loads_once_per_worker_and_gets_full_batches(spark, tmp_path):
    class CountingModel(embedding.Embedder):
        """Writes down each load and each call."""

        dim = 1

        def __init__(self, folder: str):
            self.folder = folder

        def _note(self, name: str, text: str) -> None:
            with open(f"{self.folder}/{name}", "a") as file:
                file.write(f"{os.getpid()} {text}\n")

        def load(self):
            self._note("loads", "")

            def embed(texts):
                self._note("calls", f"{TaskContext.get().partitionId()} {len(texts)}")
                return np.ones((len(texts), 1))

            return embed

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        rows = spark.range(5000).select("id", F.col("id").cast("string").alias("text")).repartition(50)
        assert embedding.embed_texts(rows, CountingModel(str(tmp_path)), 32).where("embedding[0] = 1").count() == 5000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    workers = [line.split()[0] for line in (tmp_path / "loads").read_text().splitlines()]
    assert len(workers) == len(set(workers)) < 50
    calls = [tuple(map(int, line.split()))[1:] for line in (tmp_path / "calls").read_text().splitlines()]
    assert len({task for task, _ in calls}) == 50
    assert all(sum(n < 32 for task, n in calls if task == t) <= 1 for t in range(50))


def test_image_files_share_folders(spark, tmp_path):
    """One file per row, also for rows of one name, but no folder for each: listing takes a task per folder."""
    rows = [(f"{i} x.bmp", bytearray(b"%d" % i)) for i in range(300)] + [("7 x.bmp", bytearray(b"again")), ("8 x.bmp", None)]
    images.write_image_files(spark.createDataFrame(rows, "name string, data binary"), f"{tmp_path}/out")
    found = list((tmp_path / "out").rglob("*.bmp"))
    assert sorted(f.read_bytes() for f in found) == sorted((bytes(d) if d else b"") + b"\n" for _, d in rows)
    assert len({f.name for f in found}) == len(rows)
    assert len(list((tmp_path / "out").iterdir())) <= 4 * spark.sparkContext.defaultParallelism


def test_a_backlog_takes_few_triggers(spark, folder, tmp_path):
    images_, batches = images.read_image_stream(spark, folder, files_per_trigger=1, most_triggers=3), []
    query = images_.writeStream.foreachBatch(lambda df, i: batches.append(df.count())).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "progress")).start().awaitTermination()
    assert sum(batches) == len(SOLIDS) + 1 and len(batches) == 3


def test_a_long_backlog_is_taken_by_groups_of_folders(spark, folder, tmp_path):
    """Every file is in one group, and no driver remembers more files than a group has."""
    for name, files in (("a", 3), ("b,1", 2), ("c d", 1), ("e", 7), ("none", 0)):
        (tmp_path / "in" / name).mkdir(parents=True)
        for i in range(files):
            (tmp_path / "in" / name / f"{i}.png").write_bytes(png(SOLIDS["rgb.png"][0]))
    groups = images.image_backlogs(spark, f"{tmp_path}/in", most_triggers=6, most_files=5)
    assert [share for _, share in groups] == [2, 1, 3]
    before = {key: spark.conf.get(key, None) for key in images._SMALL_FILES_CONF}
    counts, origins = [], set()
    for n, (pattern, share) in enumerate(groups):
        batches = []
        with images.small_files(spark):
            stream = images.read_image_stream(spark, pattern, files_per_trigger=1, most_triggers=share)
            query = stream.writeStream.foreachBatch(lambda df, i: batches.append([r[0] for r in df.select("image.origin").collect()]))
            query = query.option("checkpointLocation", f"{tmp_path}/p{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(batches) <= share
        counts.append(sum(map(len, batches)))
        origins.update(x for b in batches for x in b)
    assert counts == [5, 1, 7] and len(origins) == 13
    assert before == {key: spark.conf.get(key, None) for key in images._SMALL_FILES_CONF}
