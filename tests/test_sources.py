"""Scans, sinks and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import manifests as M
from tessera.sources import sinks as K
from tessera.streaming import chunks


def test_jsonl(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id": "a", "duration": 1.5}\n\n{"id": "b", "duration": 2}\n')
    rows = M.numbered_jsonl(spark, str(p), "id string, duration double", "train").orderBy("manifest_line").collect()
    assert [(r.id, r.split, r.manifest_line) for r in rows] == [("a", "train", 1), ("b", "train", 2)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(Exception):
        M.jsonl(spark, str(bad), "id string").collect()
    assert M.bad_lines(spark, str(bad), "id string").first().line == "{oops"


def test_lookups_and_listings(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"22")
    assert [r.length for r in M.listing(spark, str(tmp_path), "*.wav").collect()] == [1]
    s = spark.createDataFrame([(0, 0, "a", 5), (0, 1, "b", 6)], "shard int, row_index int, id string, v int")
    assert M.point_lookup(s.drop("v"), s, ["id"]).count() == 2
    with pytest.raises(Exception, match="differ"):
        M.point_lookup(s.drop("v").withColumn("id", F.lit("z")), s, ["id"]).collect()
    assert M.named(["a=1", "b=2"]) == {"a": "1", "b": "2"}
    for wrong in (["a=1", "a=2"], ["=x"], ["a b=1"]):
        with pytest.raises(ValueError):
            M.named(wrong)
    assert M.config_path("a/../b", "/r") == "/r/b"
    d = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]],)], "c array<array<double>>")
    assert d.select(M.downmix(F.col("c")).alias("m")).first().m == [2.0, 4.0]


def test_run_grid(spark, tmp_path):
    for name in ("rq_c0_seed42", "rq_c1_seed43"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "all.json").write_text(json.dumps({"test_wer": 1.5}, indent=1))
    g = M.run_grid(spark, f"{tmp_path}/*/all.json", r"rq_(c\d)_seed(\d+)", ["condition", "seed"], "test_wer double")
    assert sorted((r.condition, r.seed, r.test_wer) for r in g.collect()) == [("c0", "42", 1.5), ("c1", "43", 1.5)]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    p = f"{tmp_path}/t"
    K.write_staged(df, p)
    with pytest.raises(FileExistsError):
        K.write_staged(df, p)
    K.write_staged(spark.range(7), p, replace=True)
    assert spark.read.parquet(p).count() == 7
    with pytest.raises(Exception):
        K.write_staged(df.select(F.raise_error(F.lit("no")).alias("x")), f"{tmp_path}/u")
    assert not [x for x in tmp_path.iterdir() if "staging" in x.name] and not (tmp_path / "u").exists()
    with pytest.raises(Exception):
        K.write_jsonl(df, p, immutable=True)
    f = f"{tmp_path}/a.txt"
    assert K.write_text(spark, f, "one\n") and not K.write_text(spark, f, "one\n") and not K.write_text(spark, f, "two", "absent")
    with pytest.raises(FileExistsError):
        K.write_text(spark, f, "two")
    with pytest.raises(FileExistsError):
        K.write_all_or_none(spark, {f"{tmp_path}/new.txt": "x", f: "two"})
    assert not (tmp_path / "new.txt").exists()
    assert K.replace_block("a<b>old<e>c", "<b>", "<e>", "new") == "a<b>\nnew\n<e>c"
    with pytest.raises(ValueError):
        K.replace_block("<b><b><e>", "<b>", "<e>", "x")
    assert K.mean_sd(1.234, 0.5) == "1.23 ± 0.50" and K.mean_sd(None, None) == "n/a"
    assert K.markdown_table([{"a": 1, "b": 2}]) == "| a | b |\n|---|---|\n| 1 | 2 |\n"
    assert K.union_columns(df, spark.range(1).withColumn("x", F.lit(1))).columns == ["id", "x"]


def test_chunks_resume(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"))
    p = f"{tmp_path}/c"
    first = K.chunked(df, p, "pos", 4, "v1").orderBy("chunk").collect()
    assert [(r.first, r.last, r.rows) for r in first] == [(0, 3, 4), (4, 7, 4), (8, 9, 2)]
    stamp = {x.name: x.stat().st_mtime_ns for x in (tmp_path / "c/rows").rglob("*.parquet")}
    changed = df.withColumn("id", F.when(F.col("pos") == 9, "nine").otherwise(F.col("id")))
    K.chunked(changed, p, "pos", 4, "v1")
    kept = {x.name for x in (tmp_path / "c/rows").rglob("*.parquet")} & set(stamp)
    assert kept and K.consolidated(spark, p, "pos", changed).count() == 10
    with pytest.raises(Exception, match="manifest"):
        K.consolidated(spark, p, "pos", df).collect()


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    work = lambda b: b.withColumn("y", F.col("x") * 2)
    go = lambda: chunks.resume(spark, str(src), "x int", work, f"{tmp_path}/out", f"{tmp_path}/cp", 1)
    (src / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    go()
    (src / "b.json").write_text('{"x": 3}\n')
    go()
    assert sorted(r.y for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 4, 6]


def test_epoch_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "e1.json").write_text("\n".join(json.dumps({"epoch": 1, "id": str(i), "nll": float(9 - i), "duration": 1.0, "dataset_index": i}) for i in range(4)))
    chunks.epoch_states(spark, str(src), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").orderBy("position").collect()] == ["3", "2", "1", "0"]


def test_wav_header_and_stretch(spark, tmp_path):
    import wave

    import numpy as np

    from tessera.functions.arrays import ratio, stretch

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 4000)
    (tmp_path / "b.wav").write_bytes(b"not a wave file")
    rows = M.listing(spark, str(tmp_path), "*.wav").select("path").join(spark.read.format("binaryFile").load(str(tmp_path)), "path").orderBy("path").select(M.wav_header("content").alias("h")).collect()
    assert tuple(rows[0].h) == (8000, 2, 16, 0.5) and tuple(rows[1].h) == (None,) * 4
    assert ratio(0.9) == (9, 10)
    t = np.sin(np.arange(4000) * 2 * np.pi * 440 / 8000)
    out = np.array(spark.createDataFrame([(t.tolist(), 1.25)], "x array<double>, f double").select(stretch("x", "f").alias("y")).first().y)
    assert len(out) == 3200 and abs(np.abs(np.fft.rfft(out)).argmax() * 8000 / 3200 - 440) < 5
