"""Round trips through tar shards and PNG."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib

from arbitra.llm import media


def test_png_round_trip():
    for n in (0, 1, 63, 64, 65, 5000):
        p = media.payload(bytes(range(256)) * 20 if n == 5000 else b"a" * n)
        stored = media.encode(p)
        assert len(p) % 64 == 0 and len(p) >= max(64, n)
        assert media.decode(stored) == p
        assert media.header(stored[: media.HEADER]) == (64, len(p) // 64, 8)


def test_odd(spark, odd, none, tmp_path):
    stored = media.store(odd, f"file://{tmp_path}/shards", shard_bytes=2000)
    rows = media.media_columns(stored).collect()
    assert len(rows) == odd.count()
    texts = {(r["doc_id"], len((r["text"] or "").encode())): (r["text"] or "").encode() for r in odd.collect()}
    for r in rows:
        p = media.payload(texts[r["doc_id"], r["n_bytes"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["payload_sha256"] == r["digest"] and r["feature"] == media.feature(p)
        with open(f"{tmp_path}/shards/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            data = f.read(r["length"])
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["media_bytes"], r["media_sha256"])
    assert media.media_columns(media.store(none)).count() == 0


def test_shards_are_tar_files(spark, odd, tmp_path):
    media.store(odd, f"file://{tmp_path}/s", shard_bytes=1000).count()
    shards = sorted((tmp_path / "s").glob("*.tar"))
    assert len(shards) > 1 and not list((tmp_path / "s").glob(".*"))
    for s in shards:
        with tarfile.open(s) as t:
            names = t.getnames()
            assert len(names) == len(set(names))
            for m in t.getmembers():
                assert hashlib.sha256(media.decode(io.BytesIO(t.extractfile(m).read()).read())).hexdigest() + ".png" == m.name


def test_folders_without_a_scheme(spark, monkeypatch):
    """They are on the default file system, as tables of such names are."""
    assert media._qualified(spark, "hdfs://n/x") == "hdfs://n/x" and media._qualified(spark, "file:/x") == "file:///x" and media._qualified(spark, "/x") == "file:///x"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://name:9000/")
    try:
        assert media._qualified(spark, "/shared/x") == "hdfs://name:9000/shared/x"
    finally:
        conf.set("fs.defaultFS", before)
