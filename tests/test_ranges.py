"""Binary files by byte ranges: the same rows whatever the cuts, files larger than an array, columns that are not asked for."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources import binary, ranges

FIELDS = [("magic", "S4"), ("type", "<u4"), ("start", ("<f4", 3)), ("rest", "S52")]


def facets(n, seed=0):
    x = np.zeros(n, ranges.FACETS)
    x["v"] = np.random.default_rng(seed).normal(size=(n, 9))
    x["attr"] = np.arange(n) % 60_000
    return x


def stl(x):
    return b"\1" * 80 + struct.pack("<I", len(x)) + x.tobytes()


@pytest.mark.parametrize("split", [170, 5000])
def test_triangles_whatever_the_cuts(spark, tmp_path, split):
    x = facets(501)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.stl").write_bytes(stl(x) + b"tail")
    (tmp_path / "short.stl").write_bytes(stl(x[:3])[:-70])  # the header tells more than there is
    (tmp_path / "less.stl").write_bytes(stl(x[:3])[:80] + struct.pack("<I", 2) + x[:9].tobytes())  # and here less
    (tmp_path / "empty.stl").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(stl(x))
    got = ranges.read_facets(spark, str(tmp_path), "face_id long, attr int, model string, v array<double>", split=split)
    if split == 5000:
        assert got.rdd.getNumPartitions() >= 6
    rows = {}
    for r in got.collect():
        rows.setdefault(r["model"].rsplit("/", 1)[1], []).append((r["face_id"], r["attr"], tuple(r["v"])))
    assert {k: len(v) for k, v in rows.items()} == {"a.stl": 501, "short.stl": 1, "less.stl": 2}
    assert sorted(rows["a.stl"]) == [(i, i, tuple(map(float, v))) for i, v in enumerate(x["v"])]


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Sparse, so that it takes no room: triangles at its very end are read."""
    n = 44_000_000
    last = facets(2)
    with open(tmp_path / "big.stl", "wb") as f:
        f.write(b"\0" * 80 + struct.pack("<I", n))
        f.seek(84 + 50 * (n - 2))
        f.write(last.tobytes())
    assert (tmp_path / "big.stl").stat().st_size > 2**31
    got = ranges.read_facets(spark, str(tmp_path), "face_id long, attr int")
    assert got.rdd.getNumPartitions() > 30
    assert got.agg(F.count(F.lit(1)).alias("n"), F.max("face_id").alias("last"), F.sum("attr").alias("a")).first() == (n, n - 1, 1)


def brute(raw, magic, stride):
    """Offsets of a file's records, by the rule."""
    at = raw.find(magic)
    while at >= 0 and raw[at + stride : at + stride + len(magic)] != magic and at + 2 * stride <= len(raw):
        at = raw.find(magic, at + 1)
    out = []
    while at >= 0 and at + stride <= len(raw) and raw.startswith(magic, at):
        out.append(at)
        at += stride
    return out


def record(i, rest=b"\0" * 52):
    return b"MAGC" + struct.pack("<I3f", i, 1.0 * i, 2.0, 3.0) + rest


def test_records_whatever_the_cuts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    inner = b"xxMAGCyy".ljust(52, b"\0")
    bodies = {
        "plain": b"junkMAGCx" + b"\0" * 100 + b"".join(record(i) for i in range(1, 40)) + b"tail",
        "false starts": record(7)[:30] + b"".join(record(i, inner if i % 3 else b"\0" * 52) for i in range(20)) + b"MAGC",
        "two runs": b"".join(record(i) for i in range(5)) + b"gap" + b"".join(record(i) for i in range(9)),
        "alone": b"abc" + record(3), "alone and short": b"abc" + record(3)[:50], "none": b"nothing", "nothing": b"",
        "ends in a magic": record(1) + record(2) + b"MAGC" + b"1" * 20,
    }
    for k in range(12):
        bodies[f"random {k}"] = b"".join([record(i, bytes(rng.integers(60, 80, 52, dtype=np.uint8))) if rng.random() < 0.8 else b"MAGC" * int(rng.integers(0, 9)) for i in range(25)])
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    want = {name: offs for name, body in bodies.items() if (offs := brute(body, b"MAGC", 72))}
    assert len(want) > 12
    for split in (700, 1 << 20):
        got = {}
        for r in ranges.read_records(spark, str(tmp_path), b"MAGC", FIELDS, split=split).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["rec_no"], r["offset"], r["type"], r["start"][0], bytes(r["rest"])))
        assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == want
        for k, v in got.items():
            for i, (no, off, kind, start, rest) in enumerate(sorted(v)):
                raw = bodies[k][off : off + 72]
                assert (no, kind, rest) == (i, int.from_bytes(raw[4:8], "little"), raw[20:]) and np.isclose(start, struct.unpack("<f", raw[8:12])[0])


def test_pieces_within_a_range(spark, tmp_path, monkeypatch):
    """Pieces of a few bytes give what one piece gives (in this process, without Spark)."""
    body = b"junk" + b"".join(record(i) for i in range(50)) + b"tail"
    (tmp_path / "a").write_bytes(body)

    class Schema:
        names, fields = ["offset", "goes_on_", "type"], []

    options = {"path": str(tmp_path), "magic": b"MAGC".hex(), "stride": "72", "fields": __import__("json").dumps(FIELDS)}
    out = []
    for piece, split in ((40, 31), (7, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(ranges, "PIECE", piece)
        reader = ranges.PlaceReader({**options, "split": str(split)}, Schema)
        out.append([r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()])
    assert out[0] == out[1] == out[2] and len(out[0]) == 50


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", bytearray(b"12")), ("b.bin", bytearray(b"")), ("c.bin", None)], "name string, content binary")
    ranges.write_files(df, str(tmp_path))
    got = {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert got == {"a/x.bin": b"12", "b.bin": b"", "c.bin": b""}
    assert binary.triage(spark.createDataFrame([("p", 184)], "path string, length long")).first()["faces"] == 2
