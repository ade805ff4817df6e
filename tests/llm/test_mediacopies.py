import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import images, mediacopies, renders
from graphloom.llm.hammingtrie import merge


def picture_of(seed, linear=False):
    return renders.render(np.random.default_rng(seed).normal(size=64), linear)


def ppm(grey):
    rgb = np.repeat(grey.astype(np.uint8)[:, :, None], 3, axis=2)
    return b"P6\n# made up\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + rgb.tobytes()


def png(w, h, depth, colour, lines, interlaced=0, palette=None):
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")]
    if palette is not None:
        chunks.insert(1, (b"PLTE", palette))
    return images.PNG_MAGIC + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def test_formats_agree():
    picture = picture_of(1)
    assert np.abs(images.decode(images.encode_png(picture)) - images.decode(ppm(picture))).max() < 1e-3
    for bad in (None, b"", b"P5", b"GIF89a", images.PNG_MAGIC, images.encode_png(picture)[:60], images.encode_png(picture)[:20], b"P5 3 3 255 x"):
        assert images.decode(bad) is None


def test_kinds_of_png():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
    plain = images.decode(images.encode_png(grey))
    assert np.allclose(plain, grey)
    wide = b"".join(b"\0" + (row.astype(">u2") * 257).tobytes() for row in grey)
    assert np.allclose(images.decode(png(7, 5, 16, 0, wide)), grey)
    index = b"".join(b"\0" + bytes(range(7 * y, 7 * y + 7)) for y in range(5))
    table = b"".join(bytes([7 * k] * 3) for k in range(35))
    assert np.allclose(images.decode(png(7, 5, 8, 3, index, palette=table)), grey, atol=1e-3)
    assert images.decode(png(7, 5, 8, 3, index)) is None
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    mixed = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in passes for row in grey[y::dy, x::dx] if len(row))
    assert np.allclose(images.decode(png(7, 5, 8, 0, mixed, interlaced=1)), grey)
    bits = (grey % 2).astype(bool)
    one = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)
    assert np.allclose(images.decode(png(7, 5, 1, 0, one)), bits * 255)
    steps = np.diff(grey.astype(int), axis=0, prepend=0) % 256
    average, paeth = [], []
    for y in range(5):
        for x in range(7):
            a, b, c = (int(grey[y, x - 1]) if x else 0), (int(grey[y - 1, x]) if y else 0), (int(grey[y - 1, x - 1]) if x and y else 0)
            average.append((int(grey[y, x]) - (a + b) // 2) % 256)
            guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
            paeth.append((int(grey[y, x]) - guess) % 256)
    for rule, values in ((2, steps), (3, np.array(average).reshape(5, 7)), (4, np.array(paeth).reshape(5, 7))):
        assert np.allclose(images.decode(png(7, 5, 8, 0, b"".join(bytes([rule]) + row.astype(np.uint8).tobytes() for row in values))), grey)


def test_consensus_survives_noise_matches():
    rng = np.random.default_rng(3)
    left = np.column_stack((rng.uniform(0, 90, (20, 2)), np.ones(20), rng.uniform(-3, 3, 20)))
    turn, scale = 0.5, 0.8
    mapped = np.column_stack((scale * (np.cos(turn) * left[:, 0] - np.sin(turn) * left[:, 1]) + 4, scale * (np.sin(turn) * left[:, 0] + np.cos(turn) * left[:, 1]) - 2, np.full(20, scale), left[:, 3] + turn))
    mapped[12:] = rng.uniform(0, 90, (8, 4))
    assert images.consensus(left, mapped) >= 12
    assert images.consensus(left, rng.permutation(mapped)) < 7
    assert images.consensus(left[:0], mapped[:0]) == 0


def entries(bits):
    return {(t, bytes(row[places])) for row in bits for t, places in enumerate(mediacopies.TABLE_BYTES)}


def linked(x, y):
    """The rule by which two images are linked, on their corners alone."""
    if len(entries(x[1]) & entries(y[1])) < 2:
        return False
    m = images.mutual_matches(x[1], y[1])
    return len(m) >= 4 and images.consensus(x[0][m[:, 0]], y[0][m[:, 1]]) >= 4


@pytest.mark.parametrize("kind", renders.EDITS)
def test_recall_of_each_edit(kind):
    """Amounts over the whole range of the edit, none of them chosen for the method's own scales."""
    found = []
    for k in range(20):
        picture, rng = picture_of(500 + k, k % 2 == 0), np.random.default_rng(k)
        copy = renders.edited(picture, kind, rng, (k + 0.5) / 20)
        found.append(linked(images.descriptors(picture), images.descriptors(copy)))
    # turned and scaled at once, copies are found less often: the README has the figure
    assert np.mean(found) >= (0.75 if kind == "turn and scale" else 0.9), (kind, found)


def test_unlike_pictures_are_not_linked():
    seen = [images.descriptors(picture_of(900 + k, k % 2 == 0)) for k in range(30)]
    assert not any(linked(x, y) for x, y in itertools.combinations(seen, 2))


def brute_classes(rows):
    """The least id of each component of all pairs of images, compared one by one."""
    corners = [images.descriptors(images.decode(data)) for _, data in rows]
    label = np.arange(len(rows))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][1] == rows[j][1] or linked(corners[i], corners[j])]
    if pairs:
        merge(label, *np.array(pairs).T)
    return {i: rows[c][0] for (i, _), c in zip(rows, label)}


def test_classes_against_all_pairs(spark):
    """Families of edited copies, some of them linked only through others, and look-alikes."""
    rng, rows = np.random.default_rng(8), []
    for k in range(7):
        picture = picture_of(100 + k, k % 2 == 0)
        family = [picture] + [renders.edited(picture, renders.EDITS[(3 * k + e) % len(renders.EDITS)], rng) for e in range(4)]
        family += [renders.edited(family[1], "crop", rng, 0.9), renders.edited(family[2], "scale", rng, 1.0)]
        rows += [(len(rows) + n, images.encode_png(p)) for n, p in enumerate(family)]
    rows = [(int(i), data) for i, (_, data) in zip(rng.permutation(1000)[: len(rows)], rows)]
    rows.sort()
    df = spark.createDataFrame([(i, bytearray(data)) for i, data in rows], "media_id long, image binary")
    got = {r.media_id: r.class_id for r in mediacopies.copy_classes(df).collect()}
    assert got == brute_classes(rows)


def test_odd_images(spark):
    rows = []
    for k in range(6):
        rows.append((10 * k, bytearray(images.encode_png(picture_of(100 + k))), "n"))
    rows += [(2, rows[0][1], "n"), (3, rows[0][1], "n"), (3, rows[0][1], "n")]  # exact copies, one row twice
    rows += [(901, None, "n"), (902, bytearray(b"broken"), "n"), (903, bytearray(b"broken"), "n"), (904, bytearray(b""), "n"), (None, rows[5][1], "n")]
    rows += [(905, bytearray(images.PNG_MAGIC), "n"), (906, bytearray(images.encode_png(np.full((90, 90), 7))), "n"), (907, bytearray(images.encode_png(np.ones((1, 1)))), "n")]
    df = spark.createDataFrame(rows, "media_id long, image binary, class_id string")
    got = mediacopies.copy_classes(df).collect()
    assert len(got) == len(rows)
    by_id = {r.media_id: r for r in got}
    assert all(by_id[10 * k].class_id == 10 * k for k in range(6))
    assert by_id[2].class_id == by_id[3].class_id == 0 and by_id[0].class_size == 4 and by_id[20].class_size == 1
    assert by_id[901].class_id == 901 and by_id[903].class_id == 902 and by_id[904].class_id == 904 and by_id[None].class_id is None
    assert by_id[901].readable is None and not by_id[905].readable and by_id[906].readable and by_id[907].readable
    assert mediacopies.copy_classes(df.where("false")).count() == 0


def test_members_of_one_class_are_not_paired_again(spark):
    """An entry of 300 images of one class gives no pair, one with another class only pairs across."""
    members = spark.createDataFrame([(e, k) for e in (1, 2) for k in range(300)] + [(3, 5), (4, 5), (3, 900), (4, 900)], "entry long, id long")
    roots = spark.createDataFrame([(k, 0) for k in range(1, 300)], "node long, root long")
    assert [tuple(r) for r in mediacopies.cross_pairs(members, roots).collect()] == [(5, 900)]
    assert mediacopies.centre_pairs(members, F.min("id")).count() == 300


def test_runs_of_entries_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(range(len(e)), pa.int64())], names=["entry", "id"]) for e in ([1, 1, 2], [2], [2, 2], [3], [4, 4], [])]
    got = [e.tolist() for e, _ in mediacopies.entry_groups(iter(batches))]
    assert [x for run in got for x in run] == [1, 1, 2, 2, 2, 2, 3, 4, 4]
    ends = [set(run) for run in got]
    assert all(not a & b for a, b in itertools.combinations(ends, 2))


def test_copies_of_all_vectors(spark, sf_dir):
    """Copies of every fifth vector of the whole smallest table."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {r.media_id: r.class_id for r in mediacopies.copy_classes(renders.media_from_vectors(vectors)).collect()}
    edited = [i for i in got if i % 2]
    assert len(edited) == 100 and np.mean([got[i] == got[i - 1] for i in edited]) >= 0.9
    assert np.mean([got[i] == i for i in got if i % 2 == 0]) >= 0.98


def test_unlike_copies_share_few_entries():
    """Edges of bars and of turned canvases look alike in unlike pictures, but hardly ever twice by their entries."""
    seen = []
    for k in range(120):
        copy = renders.edited(picture_of(2000 + k, True), ("bar", "turn")[k % 2], np.random.default_rng(k))
        seen.append(entries(images.descriptors(copy)[1]))
    shared = [len(x & y) for x, y in itertools.combinations(seen, 2)]
    assert sum(n >= 2 for n in shared) <= 20 and sum(shared) <= 500
    assert all(len(places) == mediacopies.ENTRY_BYTES and max(places) < images.TELLING_BYTES for places in mediacopies.TABLE_BYTES)
