import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from tarn.sinks import package
from tarn.sources import files, releases


def test_digests_however_files_are_read(spark, tmp_path):
    contents = {"b.bin": b"x" * 1000, "sub/c d.bin": os.urandom(200_000)}
    for name, raw in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    wanted = {(name.rsplit("/", 1)[-1], len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in contents.items()}
    for whole in (1 << 20, 500, -1):
        found = files.digests(spark, str(tmp_path), whole)
        assert {(r["n"], r["bytes"], r["sha256"]) for r in found.select(F.regexp_extract("path", "[^/]+$", 0).alias("n"), "bytes", "sha256").collect()} == wanted


def test_ranges_tell_where_a_file_changed(spark, tmp_path):
    raw = bytearray(os.urandom(10_000))
    (tmp_path / "f").write_bytes(raw)
    (tmp_path / "empty").write_bytes(b"")
    before = spark.createDataFrame(files.range_digests(spark, str(tmp_path), 1024).collect())
    assert before.count() == 10 and {(r["start"], r["bytes"], r["sha256"]) for r in before.collect()} == {(a, len(raw[a : a + 1024]), hashlib.sha256(raw[a : a + 1024]).hexdigest()) for a in range(0, 10_000, 1024)}
    root = files.tree_digests(before).first()
    assert (root["bytes"], root["ranges"], root["root"]) == (10_000, 10, hashlib.sha256("".join(hashlib.sha256(raw[a : a + 1024]).hexdigest() for a in range(0, 10_000, 1024)).encode()).hexdigest())
    raw[5000] ^= 1
    (tmp_path / "f").write_bytes(raw + b"more")
    assert {r["start"] for r in files.damaged(before, files.range_digests(spark, str(tmp_path), 1024)).collect()} == {4096, 9216}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse: three gigabytes of zeros, with a mark at the end."""
    path, size = tmp_path / "large", 3 << 30
    with open(path, "wb") as file:
        file.truncate(size)
        file.seek(size - 4)
        file.write(b"mark")
    digest = hashlib.sha256()
    zeros = bytes(8 << 20)
    for _ in range(size // len(zeros) - 1):
        digest.update(zeros)
    digest.update(zeros[:-4] + b"mark")
    found = files.digests(spark, str(path)).collect()
    assert [(r["bytes"], r["sha256"]) for r in found] == [(size, digest.hexdigest())]
    assert releases._facts(spark, str(path)).first()["bytes"] == size
    path.unlink()


def test_generations(spark, tmp_path):
    path = str(tmp_path / "p a")
    one, two = spark.range(3).select(F.col("id").alias("x")), spark.range(5).select(F.col("id").alias("x"))
    with pytest.raises(FileNotFoundError):
        package.pinned(spark, path)
    assert package.write_generation(spark, path, {"t": one}) == 1
    first = package.pinned(spark, path)
    assert package.write_generation(spark, path, {"t": two}, {"n": 2}, form="csv") == 2
    assert package.load_package(spark, first)["t"].count() == 3 and package.load_package(spark, package.pinned(spark, path))["t"].count() == 5
    assert package.pinned(spark, path, 1) == first and package.verification(spark, package.pinned(spark, path, 2)).first()["status"] == "verified"
    with pytest.raises(FileExistsError):
        package.write_generation(spark, path, {"t": one}, after=1)
    assert len([n for n in os.listdir(path) if n.startswith("generation-")]) == 2
    assert package.write_generation(spark, path, {"t": one}) == 3 and package.retire(spark, path, 1) == [1, 2] and package.retire(spark, path, 1) == []
    assert package.load_package(spark, package.pinned(spark, path))["t"].count() == 3 and package.write_generation(spark, path, {"t": two}) == 4


def test_of_writers_at_once_one_wins(spark, tmp_path):
    path, won, lost = str(tmp_path / "p"), [], []
    package.write_generation(spark, path, {"t": spark.range(1)})

    def write(n):
        try:
            won.append((n, package.write_generation(spark, path, {"t": spark.range(n), "u": spark.range(n)}, after=1)))
        except FileExistsError:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2, 6)]
    for t in threads:
        t.start()
    seen = {tuple(df.count() for df in package.load_package(spark, package.pinned(spark, path)).values()) for _ in range(3)}
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and won[0][1] == 2
    n = won[0][0]
    assert {df.count() for df in package.load_package(spark, package.pinned(spark, path)).values()} == {n} and seen <= {(1,), (n, n)}


def test_a_pointer_that_is_being_written_is_none(spark, tmp_path):
    path = str(tmp_path / "p")
    package.write_generation(spark, path, {"t": spark.range(1)})
    (tmp_path / "p" / package.POINTERS / "00000002").write_text("generation-")
    assert list(package.generations(spark, path)) == [1]


def test_equal_tables_give_equal_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("s"), (F.col("id") / 3).alias("x"), F.timestamp_micros(F.col("id") * 1_000_003).alias("at")).coalesce(1)
    for name in ("a", "b"):
        package.write_package(spark, str(tmp_path / name), {"t": rows})
    found = [package.inventory(spark, str(tmp_path / n)).select("bytes", "sha256").collect() for n in ("a", "b")]
    assert found[0] == found[1] and len(found[0]) == 1
    meta = pq.ParquetFile(next((tmp_path / "a" / "t").glob("*.parquet"))).metadata
    assert meta.num_row_groups == 1 and all("DICTIONARY" not in str(meta.row_group(0).column(i).encodings) for i in range(4))
