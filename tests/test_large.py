"""The ordered document, large vocabularies, signals, metadata and replayed requests: edge cases and plain versions."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediafold.functions.metadata import exif_metadata, probe_metadata
from mediafold.functions.text import path_order
from mediafold.operators import blocked, dsp, endpoint, ordered, signals
from mediafold.operators.zeroshot import AUDIO, Gate, zero_shot


@pytest.mark.parametrize("kind", ["json", "markdown", "text"])
@pytest.mark.parametrize("parts", [1, 5])
def test_one_document(spark, tmp_path, kind, parts):
    rng = random.Random(parts)
    rows = [("/".join(rng.choice("ab-é") for _ in range(rng.randint(1, 4))), "blöck " * rng.randint(0, 5)) for _ in range(80)] + [("a", None), (None, "first"), ("a", "same"), ("a", "same")]
    frame = ordered.FRAMES[kind]
    laid = ordered.laid_out(spark.createDataFrame(rows, "path string, block string").repartition(3), [path_order(F.col("path"))], "block", frame, parts)
    got = sorted(laid.collect(), key=lambda r: r["position"])
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, (r[0] or "").split("/"), r[1]))
    assert [(r["path"], r["block"]) for r in got] == want and [r["position"] for r in got] == list(range(len(want)))
    text = (frame.head + frame.separator.join(b for _, b in want) + frame.tail).encode()
    for r in got:
        assert text[r["offset"] : r["offset"] + r["length"]].decode() == r["piece"]
    path = str(tmp_path / "document")
    assert ordered.write_document(laid, path, frame) == len(text)
    with open(path, "rb") as f:
        assert f.read() == text
    assert os.listdir(tmp_path) == ["document"]


def test_no_blocks_make_an_empty_document(spark, tmp_path):
    laid = ordered.laid_out(spark.createDataFrame([], "path string, block string"), [F.col("path")], "block", ordered.FRAMES["json"])
    assert ordered.write_document(laid, str(tmp_path / "d"), ordered.FRAMES["json"]) == 2 and (tmp_path / "d").read_text() == "[]"


def test_blocks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def block(k):
        made.add(1)
        return "b" * (k % 7)

    rows = spark.range(500, numPartitions=3).select(F.col("id").cast("string").alias("path"), block("id").alias("block"))
    laid = ordered.laid_out(rows, [path_order(F.col("path"))], "block", ordered.FRAMES["text"], 4).select("path", "position", "offset", "length")
    assert laid.count() == 500 and sum(r["length"] for r in laid.collect()) == sum(k % 7 for k in range(500)) + 2 * 499
    assert made.value == 500
    # positions, offsets and lengths come from the sizes: the blocks aren't read again
    assert "block:string" not in laid._jdf.queryExecution().executedPlan().toString()


def test_totals_of_many_groups(spark):
    parts = [(p, p % 7 + 1) for p in range(200) if p % 13]
    got = {r["part"]: r["n_before"] for r in ordered.totals_before(spark.createDataFrame(parts, "part int, n long"), 200, ["n"], base=4).collect()}
    assert got == {p: sum(n for q, n in parts if q < p) for p, _ in parts}


def unit(v):
    return np.asarray(v, float) / np.sqrt(np.square(np.asarray(v, float)).sum())


@pytest.mark.parametrize("label_block,row_block", [(1, 1), (7, 13), (1000, 1000)])
def test_blocks_change_nothing(spark, label_block, row_block):
    rng = np.random.default_rng(4)
    labels = [rng.normal(size=6).tolist() for _ in range(40)]
    labels += labels[:9]  # ties
    rows = [(k, labels[k % 49] if k % 3 else rng.normal(size=6).tolist()) for k in range(60)] + [(60, None), (61, [0.0] * 6), (62, [float("nan")] * 6), (63, [1.0, 2.0]), (63, labels[0])]
    vocab = [(k, v) for k, v in enumerate(labels)] + [(90, None), (91, [0.0] * 6), (92, [1.0])]
    df, words = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), spark.createDataFrame(vocab, "lid long, vec array<double>").repartition(2)
    got = {(r["vec_id"], str(r["embedding"])): r["ranking"] for r in blocked.ranked_blocks(df, words, 5, label_block=label_block, row_block=row_block).collect()}
    assert len(got) == len(rows)
    for i, v in rows:
        ranking = got[i, str(v)]
        if v is None or i in (61, 62):
            assert ranking is None
        elif len(v) < 6:
            assert ranking == []
        else:
            scores = [(-float(np.cumsum(unit(v) * unit(w))[-1]), k) for k, w in enumerate(labels)]
            want = sorted(scores)[:5]
            assert [r["lid"] for r in ranking] == [k for _, k in want] and np.allclose([r["s"] for r in ranking], [-s for s, _ in want], atol=1e-12)


def test_cells_change_nothing_and_copies_are_few(spark):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    vecs[200:] = vecs[:100]  # ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    units = np.stack([unit(v) for v in vecs])
    want = {i: [k for _, k in sorted((-float(np.cumsum(u * w)[-1]), k) for k, w in enumerate(units))[:6]] for i, u in enumerate(units)}
    for cells in ({}, {"cell_rows": 70, "cell_bytes": 90 * 64, "least": 1}, {"least": 20}):
        found = blocked.ranked_blocks(df, df.toDF("lid", "vec"), 6, label_block=9, row_block=4, **cells)
        assert {r["vec_id"]: [x["lid"] for x in r["ranking"]] for r in found.collect()} == want
    # blocks of a product are no cells: small ones make no more copies
    for n in (100_000, 600_000):
        a, b = blocked._parts(n, n, 64, 36, blocked.CELL_ROWS, blocked.CELL_BYTES, blocked.LEAST)
        assert a * b >= 36 and a + b <= 20 and n / a <= 66_000 and n * 512 / b <= blocked.CELL_BYTES


def test_products_keep_near_ties_apart():
    # scores that single precision can't tell apart are ranked by their sums in double precision
    base = np.full(64, 0.125)
    labels = np.stack([base] + [base + np.eye(64)[k % 64] * 1e-5 * (k % 5) for k in range(500)])
    labels /= np.sqrt((labels * labels).sum(axis=1))[:, None]
    x = labels[[0, 3, 77]]
    row, label, score = blocked._best(x, labels, labels.astype(np.float32), 6, 64)
    want = [(i, k) for i in range(3) for _, k in sorted((-float(np.cumsum(x[i] * w)[-1]), k) for k, w in enumerate(labels))[:6]]
    assert list(zip(row.tolist(), label.tolist(), strict=True)) == want and len(score) == 18


def test_blocked_tags_are_the_broadcast_ones(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    vocab = rows.filter("vec_id < 30").toDF("lid", "vec")
    unit_vocab = vocab.select("lid", F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, y: a + y * y))).alias("vec"))
    for gate in (AUDIO, Gate(0.2, 0.1, 0.01, 1, 0.9)):
        want = {r["vec_id"]: r["tags"] and [t["lid"] for t in r["tags"]] for r in zero_shot(rows, unit_vocab, gate).collect()}
        got = {r["vec_id"]: r["tags"] and [t["lid"] for t in r["tags"]] for r in blocked.zero_shot_blocks(rows, vocab, gate, label_block=8, row_block=100).collect()}
        assert got == want


def test_no_labels(spark):
    rows = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    got = blocked.zero_shot_blocks(rows, rows.filter("false").toDF("lid", "vec"), AUDIO).collect()
    assert [(r["vec_id"], r["tags"], r["confidence"]) for r in got] == [(1, None, None)]


def test_resampling_is_the_helper_s(spark):
    rng = np.random.default_rng(2)
    signals_ = {1: rng.normal(size=500), 2: rng.normal(size=3), 3: np.zeros(0)}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in signals_.items()] + [(4, None)], "id long, x array<double>")
    got = {}
    for r in signals.resampled_arrays(df, ["id"], "x", 44_100, 48_000, dsp.TAPS).collect():
        got.setdefault(r["id"], {})[r["k"]] = r["value"]
    for k, x in signals_.items():
        want = dsp.resample(x, 44_100, 48_000)
        assert len(got.get(k, {})) == len(want) and np.allclose([got[k][i] for i in range(len(want))] if len(want) else [], want, atol=1e-5)


def test_fitting_and_mirroring_are_the_helpers(spark):
    rows = [(n, [float(x) for x in range(n)]) for n in (1, 2, 5, 40, 41)]
    df = spark.createDataFrame(rows + [(0, []), (-1, None)], "n int, x array<double>").select("n", signals.fitted(F.col("x"), 40).alias("fit"), signals.reflected(F.col("x"), 3).alias("mirrored"))
    for r in df.collect():
        x = np.arange(float(max(r["n"], 0)))
        assert (r["fit"] is None and r["mirrored"] is None) if not len(x) else (r["fit"] == dsp.fit(x, 40).tolist() and r["mirrored"] == np.pad(x, 3, mode="reflect").tolist())


def test_spectra_are_the_helper_s(spark):
    rng = np.random.default_rng(5)
    xs = {1: rng.normal(size=20_000).astype(np.float32), 2: rng.normal(size=513).astype(np.float32)}
    bank = signals.bank_table(dsp.BANDS, dsp.FFT, dsp.RATE, dsp.LOW_HZ, dsp.HIGH_HZ)
    assert abs(sum(w for b in bank for _, w in b) - 1.364433) < 1e-5 and sum(map(len, bank)) == 577
    df = spark.createDataFrame([(k, x.tolist()) for k, x in xs.items()] + [(3, [0.5]), (4, []), (5, None)], "id long, x array<float>")
    got = {}
    for r in signals.spectra(df, ["id"], "x", dsp.FFT, dsp.HOP, bank).collect():
        got.setdefault(r["id"], {})[r["frame"]] = r["bands"]
    assert set(got) == {1, 2, 3} and len(got[3]) == 1
    for k, x in xs.items():
        want = dsp.log_mel(x)
        assert len(got[k]) == len(want) and np.allclose([got[k][f] for f in range(len(want))], want, atol=1e-3)


def test_spectra_get_long_signals_in_pieces(spark):
    rng = np.random.default_rng(7)
    fft, hop = 32, 16
    bank = signals.bank_table(6, fft, 8000, 200.0, 3800.0)
    per = signals.PIECE // hop
    sizes = [1, 2, 15, 16, 17, 31, 32, 33, 47, 48, *(per * hop + d for d in (-33, -16, -1, 0, 1, 16, 40)), 3 * per * hop + 5, 100_000]
    texts = {n: rng.integers(0, 256, n, np.uint8).tobytes() for n in sizes}
    df = spark.createDataFrame([(n, bytearray(t)) for n, t in texts.items()] + [(0, bytearray()), (-1, None)], "id int, x binary")
    most = signals.pieces(df, ["id"], "x", fft, hop, per).agg(F.max(F.octet_length("piece"))).first()[0]
    assert most <= signals.PIECE + 2 * fft  # whatever a text's length
    floats = df.select("id", F.when(F.col("x").isNotNull(), F.transform(F.split(F.regexp_replace(F.hex("x"), "(..)(?!$)", "$1,"), ","), lambda h: (F.conv(h, 16, 10).cast("float") - 128) / 128)).alias("x"))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    for rows in (df, floats.filter("id > 0")):
        got = {}
        for r in signals.spectra(rows, ["id"], "x", fft, hop, bank).collect():
            assert r["frame"] not in got.setdefault(r["id"], {})
            got[r["id"]][r["frame"]] = r["bands"]
        assert set(got) == set(sizes)
        for n, t in texts.items():
            x = (np.frombuffer(t, np.uint8).astype(float) - 128) / 128
            padded = np.pad(x, fft // 2, mode="reflect") if n > 1 else np.repeat(x, fft + 1)
            power = np.abs(np.fft.rfft(np.stack([padded[f * hop : f * hop + fft] for f in range(n // hop + 1)]) * window, axis=1)) ** 2
            want = [[10 * np.log10(max(sum(p[k] * w for k, w in b), dsp.FLOOR)) for b in bank] for p in power]
            assert sorted(got[n]) == list(range(n // hop + 1)) and np.allclose([got[n][f] for f in range(len(want))], want, atol=1e-6)


def test_probe_metadata(spark):
    def shaped(raw, shape):
        text = spark.createDataFrame([(raw,)], "raw string").select(F.to_json(shape(F.col("raw"))).alias("m")).first()["m"]
        return None if text is None else json.loads(text)

    sound = '{"format":{"duration":"2.5","bit_rate":"900","format_name":"wav","tags":{"title":"x","n":5,"long":"%s","o":{"a":[1]}}},"streams":[{"codec_type":"audio","codec_name":"pcm","sample_rate":"48000"}]}'
    want = {"duration_s": 2.5, "bitrate": 900, "container": "wav", "format_tags": {"title": "x", "n": 5, "o": {"a": [1]}}, "audio_codec": "pcm", "sample_rate": 48000}
    assert shaped(sound % ("é" * 257), probe_metadata) == want
    video = '{"format":{"duration":" 2","bit_rate":"-9"},"streams":[{"codec_type":"video","width":128,"avg_frame_rate":"10/1"},{"codec_type":"audio","sample_rate":"x"},{"codec_type":"video","codec_name":"late"},{"codec_type":"audio","codec_name":"late"}]}'
    assert shaped(video, probe_metadata) == {"codec": None, "width": 128, "height": None, "fps": "10/1", "audio_codec": None, "sample_rate": 0}
    assert shaped('{"streams":[{"codec_type":"audio","sample_rate":5}]}', probe_metadata) == {"audio_codec": None}
    assert [shaped(x, probe_metadata) for x in ("{}", "[]", "broken", None)] == [{}, {}, None, None]
    exif = '[{"SourceFile":"a","ExifTool":"1","ExifToolVersion":12.5,"ImageWidth":64,"ImageHeight":"48","ISO":100,"long":"%s"},{"Make":"second"}]' % ("x" * 513)
    assert shaped(exif, exif_metadata) == {"width": 64, "exif": {"ExifToolVersion": 12.5, "ImageWidth": 64, "ImageHeight": "48", "ISO": 100}}
    assert [shaped(x, exif_metadata) for x in ("[]", "{}", "[7]", '[{"ImageWidth":-1}]', "x")] == [{"exif": {}}, {"exif": {}}, {"exif": {}}, {"exif": {"ImageWidth": -1}}, None]


def test_replayed_requests(spark):
    good = json.dumps({"choices": [{"message": {"content": 'Sure: {"tags": ["a"]}'}}]})
    scripts = {
        "good": [(200, good)], "second": [(503, "busy"), (200, good)], "never": [(500, "x")], "refused": [(400, '{"error":{"message":"no"}}'), (200, good)], "many": [(429, ""), (None, None), (302, "moved")],
        "empty": [], "none": None, "thought": [(200, json.dumps({"choices": [{"message": {"content": " ", "reasoning": '{"x": 1}'}}]}))],
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in scripts.items()], f"id string, replies {endpoint.REPLIES}, log int")
    got = {r["id"]: (r[3], r["reply"]) for r in endpoint.replayed(df).collect()}
    states = lambda k: [tuple(x) for x in got[k][0]]
    assert states("good") == [(1, 200, None, None)] and json.loads(got["good"][1]) == {"tags": ["a"]}
    assert states("second") == [(1, 503, "HTTP 503: busy", 250), (2, 200, None, None)]
    assert states("never") == [(1, 500, "HTTP 500: x", 250), (2, 500, "HTTP 500: x", 500), (3, 500, "HTTP 500: x", None)] and got["never"][1] is None
    assert states("refused") == [(1, 400, "HTTP 400: no", None)]
    assert states("many") == [(1, 429, "HTTP 429: ", 250), (2, None, "connection failed", 500), (3, 302, "HTTP 302: moved", None)]
    assert states("empty") == [] and got["none"] == ([], None) and json.loads(got["thought"][1]) == {"x": 1}
