import struct
import time

from pyspark.sql import functions as F

from kelpie.operators.cache import newest_slots
from kelpie.sources import binary as B
from kelpie.streaming import streams


def sidecar(key, pages, size, page=4096, flags=3, break_crc=False):
    n = -(-size // page)
    bitmap = bytearray(-(-n // 8))
    for p in pages:
        bitmap[p // 8] |= 1 << p % 8
    head = B.HEADER.pack(b"UCAC", 1, page, flags, size, 1000, 0, 0, (7).to_bytes(3, "little"), 0, len(key), 0)
    body = head + key.encode() + bytes(-(len(head) + len(key)) % 8) + bytes(bitmap) + b"".join(struct.pack("<I", 100 + i if i in pages else 0) for i in range(n))
    return body[:52] + struct.pack("<I", B.checksum(body) ^ break_crc) + body[56:]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.meta").write_bytes(sidecar("root://h:1094/f", {0, 2, 9}, 10 * 4096 - 5))
    (tmp_path / "a" / "y.meta").write_bytes(sidecar("k", {0}, 4096, break_crc=True))
    (tmp_path / "a" / "z.meta").write_bytes(b"UCAC")
    rows = {r.path[-6:]: r for r in B.load_sidecars(spark, str(tmp_path)).collect()}
    x = rows["x.meta"]
    assert (x.key, x.n_pages, x.set_pages, x.pinned, x.complete, x.size_confirmed, x.generation) == ("root://h:1094/f", 10, 3, True, True, False, 7)
    assert rows["y.meta"].error == "checksum" and rows["z.meta"].error == "short"
    assert sorted((r.page, r.crc) for r in B.explode_pages(B.load_sidecars(spark, str(tmp_path))).collect()) == [(0, 100), (2, 102), (9, 109)]


def block(store, entries):
    body = b"".join(B.BLOCK_ENTRY.pack(*e) for e in entries)
    head = B.BLOCK_HEADER.pack(b"USBLOCK1", store, 64 + len(body), len(entries), B.checksum(body), 0)
    return (head[:60] + struct.pack("<I", B.checksum(head[:60])) + body).ljust(4096, b"\0")


def test_slot_blocks(spark, tmp_path):
    data = block(5, [(1, 1, 100, 10, 0), (2, 1, 110, 10, 0)]) + b"debris".ljust(4096, b"x") + block(6, [(1, 1, 1, 1, 0)]) + block(5, [(1, 2, 900, 30, 0)])
    (tmp_path / "s.slots").write_bytes(data)
    rows = B.load_slot_blocks(spark, str(tmp_path), 5).withColumn("branch", F.lit(0))
    assert sorted((r.slot, r.off, r.len) for r in newest_slots(rows).collect()) == [(1, 900, 30), (2, 110, 10)]
    assert B.delta_decode(bytes([2, 4, 1])) == [1, 3, 2]


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_marks_expire_and_reset(spark, tmp_path):
    schema = "server string, at_s long, ok boolean"
    for i, rows in enumerate([[("a", 100, False), ("b", 100, False)], [("a", 200, False)], [("b", 300, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    rows = run_stream(spark, streams.source_marks(stream), "marks", "update")
    last = {r.server: (r["count"], r.until_s) for r in rows}
    assert last == {"a": (2, 1400), "b": (0, 0)}


def test_snapshots_and_peaks(spark, tmp_path):
    spark.createDataFrame([("p", 1, 10), ("p", 3, 30), ("p", 2, 20)], "stem string, ts long, opens long").coalesce(1).write.json(str(tmp_path / "s"))
    stream = spark.readStream.schema("stem string, ts long, opens long").json(str(tmp_path / "s"))
    assert [(r.stem, r.ts, r.opens) for r in run_stream(spark, streams.latest_snapshots(stream), "snaps", "update")] == [("p", 3, 30)]
    spark.createDataFrame([("p", 0.0, 0.0), ("p", 0.5, 9.0), ("p", 2.0, 8.0), ("p", 3.0, 9.0)], "process string, wall_s double, cpu_s double").coalesce(1).write.json(str(tmp_path / "c"))
    samples = spark.readStream.schema("process string, wall_s double, cpu_s double").json(str(tmp_path / "c"))
    assert run_stream(spark, streams.peak_cores(samples), "peaks", "update")[-1].peak == 4.0
