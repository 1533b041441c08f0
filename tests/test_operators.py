"""Zero-shot tags, merging, endpoint calls, signal and image preparation."""

import io
import json
import struct
import wave
import zlib

import numpy as np
import pytest

from mediafold.operators import dsp, embed, endpoint, imageprep, jsonspan, merge, render, vocabulary, zeroshot


def brute_tags(vec, matrix, gate):
    v = np.array(vec, float)
    n = np.sqrt((v * v).sum())
    if not (zeroshot.SMALLEST <= n < np.inf):
        return None
    s = [float(sum(a * b for a, b in zip(v, row, strict=True)) / n) for row in matrix]
    order = sorted(range(len(s)), key=lambda k: (-s[k], k))
    top, second = s[order[0]], s[order[1]] if len(order) > 1 else 0.0
    if not (top >= gate.hi or (top >= gate.lo and top - second >= gate.margin)):
        return None
    return [k for k in order[: gate.k] if s[k] >= top * gate.rel]


@pytest.mark.parametrize("gate", [zeroshot.IMAGE, zeroshot.AUDIO, zeroshot.LOOSE])
def test_zero_shot_native_arrow_and_brute_force_agree(spark, gate):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(6, 8))
    matrix[3] = matrix[2]  # a tie
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    vecs = [*rng.normal(size=(60, 8)).tolist(), [0.0] * 8, [float("nan")] * 8, [1e200] * 8, matrix[2].tolist()]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(vecs)], "k int, embedding array<double>")
    vocab = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "lid int, vec array<double>")
    native = {r.k: r.tags and [t.lid for t in r.tags] for r in zeroshot.zero_shot(rows, vocab, gate).collect()}
    arrow = {r.k: r.tags and [t.lid for t in r.tags] for r in zeroshot.zero_shot_arrow(rows, list(range(6)), matrix, gate, "k").collect()}
    want = {k: brute_tags(v, matrix, gate) for k, v in enumerate(vecs)}
    assert native == want and arrow == want


def test_scoring_shuffles_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "k int, embedding array<double>")
    vocab = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "lid int, vec array<double>")
    plan = zeroshot.zero_shot(rows, vocab, zeroshot.IMAGE)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "BroadcastNestedLoopJoin" in plan


def test_a_vocabulary_has_a_bound(spark):
    vocab = spark.range(vocabulary.MOST_LABELS + 1).selectExpr("id AS lid", "array(1.0D) AS vec")
    with pytest.raises(ValueError, match="at most"):
        zeroshot.with_vocabulary(spark.createDataFrame([([1.0],)], "embedding array<double>"), vocab)


def test_two_centred_labels_are_opposite(spark):
    vocab = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "lid int, vec array<double>")
    a, b = (r.vec for r in vocabulary.centred(vocab).orderBy("lid").collect())
    assert np.allclose(np.array(a), -np.array(b))


def test_merge_rules(spark):
    base = "path string, type string, tags array<string>, description string, summary string, model string, tag_confidence double, llm_error string, error string"
    rows = spark.createDataFrame(
        [
            ("ok", "image", ["l"], "L.", None, "local", 0.5, None, None, [" r ", ""], " R ", "S", "remote", None),
            ("kept", "image", ["l"], "L.", None, None, 0.5, None, None, None, None, None, None, "HTTP 500"),
            ("lost", "image", None, None, None, None, None, None, None, None, None, None, None, "HTTP 500"),
            ("part", "image", ["l"], "L.", None, None, 0.5, None, None, None, "R", None, "remote", None),
        ],
        base + ", llm_tags array<string>, llm_description string, llm_summary string, llm_model string, llm_failure string",
    )
    got = {r.path: r for r in merge.merged(rows).collect()}
    assert (got["ok"].tags, got["ok"].description, got["ok"].summary, got["ok"].model, got["ok"].tag_confidence) == (["r"], "R", "S", "remote", 0.5)
    assert (got["kept"].tags, got["kept"].llm_error, got["kept"].error) == (["l"], "HTTP 500", None)
    assert (got["lost"].type, got["lost"].error, got["lost"].llm_error) == (None, "HTTP 500", None)
    assert (got["part"].tags, got["part"].description) == (["l"], "R")
    assert merge.first_error(merge.merged(rows)).first().path == "lost"


def test_rendering(spark):
    rows = spark.createDataFrame([("b/x", "image", 5, ["t", "u"], 12), ("a", "audio", 6, None, None)], "path string, type string, bytes long, tags array<string>, duration_ms long")
    assert render.document(render.text_blocks(rows), "text") == "== a ==\n  type: audio\n  bytes: 6\n  path: a\n\n== b/x ==\n  type: image\n  bytes: 5\n  tags: t, u\n  duration_ms: 12ms\n  path: b/x"
    assert [r["path"] for r in json.loads(render.document(render.json_records(rows), "json"))] == ["a", "b/x"]
    assert render.document(render.json_records(rows.limit(0)), "json", single=True) == "[]"
    assert render.document(render.markdown_blocks(rows.filter("path = 'a'")), "md")== "## a\n  type: audio\n  bytes: 6\n  path: a\n\n"
    told = spark.createDataFrame([("m", '{"b": [1], "a": "é"}'), ("n", "no json"), ("o", None)], "path string, metadata string")
    got = {r.path: r.block for r in render.text_blocks(told).collect()}
    assert got["m"] == '== m ==\n  metadata:\n    {\n      "a": "é",\n      "b": [\n        1\n      ]\n    }\n  path: m'
    assert got["n"] == '== n ==\n  metadata:\n    "no json"\n  path: n' and got["o"] == "== o ==\n  path: o"
    assert json.loads(render.document(render.json_records(told.filter("path = 'm'")), "json", single=True)) == {"metadata": {"a": "é", "b": [1]}, "path": "m"}


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ('{"a": 1}', '{"a": 1}'), ('Sure: {"a": {"b": 2}} done {', '{"a": {"b": 2}}'), ('{"a": "}{\\""}', '{"a": "}{\\""}'), ("none", None), ("", None), (None, None), ('{"a": 1', None), ("{bad} {\"a\": 1}", None), ('{"a": NaN}', None),
    ],
)
def test_json_span(text, span):
    assert jsonspan.json_span(text) == span


def answer(content, **more):
    return 200, json.dumps({"choices": [{"message": {"content": content, **more}}]})


EP = endpoint.Endpoint("http://h/v1/", "m", "k")


@pytest.mark.parametrize(
    ("replies", "tags", "error", "attempts"),
    [
        ([answer('{"tags": ["a"]}')], ["a"], None, 1), ([(503, "busy"), answer('x {"tags": ["a"]}')], ["a"], None, 2), ([(400, '{"error": {"message": "no such model"}}')], None, "HTTP 400: no such model", 1),
        ([(502, "<html>" + "é" * 300)], None, "HTTP 502: <html>" + "é" * 194 + "…", 3), ([answer(None, reasoning='{"tags": ["r"]}')], ["r"], None, 1), ([answer("prose")], None, "no JSON object in the reply: prose", 3),
        ([OSError("down"), (429, "{}"), answer('{"tags": []}')], [], None, 3), ([(200, "junk")], None, "reply is no JSON: junk", 3), ([(200, '{"choices": []}')], None, "reply has no content", 3),
    ],
)
def test_analyse(replies, tags, error, attempts):
    asked, waits = [], []

    def transport(url, body, key, timeout):
        asked.append((url, key))
        r = replies[min(len(asked), len(replies)) - 1]
        if isinstance(r, OSError):
            raise r
        return r

    reply, said, n = endpoint.analyse(EP, {}, transport, waits.append)
    assert (reply and reply["tags"], said, n) == (tags, error, attempts) and len(asked) == attempts
    assert asked[0] == ("http://h/v1/chat/completions", "k") and waits == [0.25, 0.5][: attempts - 1]


def test_request_bodies():
    plain = endpoint.request_body(EP, "ask", "text")
    assert plain["messages"][1]["content"] == "text" and plain["temperature"] == 0
    parts = endpoint.request_body(EP, "ask", "text", [(b"x", "image/webp")], (b"y", "mp3"))["messages"][1]["content"]
    assert parts[1]["image_url"]["url"].startswith("data:image/webp;base64,") and parts[2]["input_audio"]["format"] == "mp3"
    assert endpoint.request_body(EP, "ask", "text", [(b"x", "image/webp")], vision=False)["messages"][1]["content"] == "text"
    with pytest.raises(ValueError, match="inline cap"):
        endpoint.request_body(endpoint.Endpoint("u", "m", inline_cap=1), "ask", "t", [(b"xx", "image/png")])


def test_endpoint_precedence():
    env = {"MEDIAFOLD_URL": "e", "MEDIAFOLD_MODEL": "em", "MEDIAFOLD_AUDIO_URL": "ea", "MEDIAFOLD_AUDIO_KEY": "ka", "MEDIAFOLD_KEY": "", "MEDIAFOLD_TIMEOUT": "x"}
    flags = endpoint.Overrides("f", None, {"vision": "fv"})
    assert endpoint.resolve("vision", flags, env) == endpoint.Endpoint("fv", "em") and endpoint.resolve("video", flags, env).url == "f"
    assert endpoint.resolve("audio", flags, env) == endpoint.Endpoint("ea", "em", "ka")
    assert endpoint.resolve("audio", flags, {}) is None


def test_enrich(spark):
    rows = spark.createDataFrame([("a", "vision", "p"), ("b", "audio", "q")], "path string, modality string, prompt string")
    got = {r.path: r for r in endpoint.enrich(rows, {"vision": EP}, "ask", lambda *_: answer('{"tags": ["x ", "", 3], "description": " d ", "summary": 5}')).collect()}
    assert (got["a"].llm_tags, got["a"].llm_description, got["a"].llm_summary, got["a"].llm_model) == (["x"], "d", "5", "m")
    assert got["b"].llm_missing == "no endpoint configured for audio" and got["b"].llm_failure is None
    got = endpoint.enrich(rows.limit(1), {"vision": EP}, "ask", lambda *_: answer('{"tags": " one ", "description": ["x"]}')).first()
    assert (got.llm_tags, got.llm_description) == (["one"], '["x"]')


def wav(x, rate=48_000, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, width, rate, 0, "NONE", ""))
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_signal_preparation(spark):
    assert abs(dsp.mel_bank().sum() - 1.364433) < 1e-5 and (dsp.mel_bank() > 0).sum() == 577
    assert dsp.reflect_pad(np.arange(1, 7), 2).tolist() == [3, 2, 1, 2, 3, 4, 5, 6, 5, 4]
    assert [len(dsp.fit(np.ones(n))) for n in (1, 48_000, 960_000)] == [480_000] * 3 and dsp.log_mel(dsp.fit(np.ones(10))).shape == (1001, 64)
    tone = np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100)
    again = dsp.resample(tone, 44_100)
    assert len(again) == 48_000 and np.abs(again[200:-200] - np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)[200:-200]).max() < 0.1
    rows = spark.createDataFrame([("t", wav(tone, 44_100)), ("s", wav(tone[:4000], 44_100)), ("x", b"junk"), ("n", None)], "path string, content binary")
    got = {r.path: r for r in dsp.audio_tensors(rows).collect()}
    assert len(got["t"].tensor) == 1001 * 64 and got["s"].tensor is None and got["s"].error is None and got["x"].error and got["n"].error


def png(pixels):
    h, w, c = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(pixels):
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = b"".join(r[:, ::-1].tobytes().ljust(stride, b"\0") for r in pixels[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_images(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (30, 41, 3), np.uint8)
    assert (imageprep.decode_image(png(pixels)) == pixels).all() and (imageprep.decode_image(bmp(pixels)) == pixels).all()
    tensor = imageprep.image_tensor(pixels)
    assert tensor.shape == (3, 224, 224) and np.isfinite(tensor).all() and np.abs(tensor).max() < 4
    flat = imageprep.image_tensor(np.full((64, 300, 3), 128, np.uint8))
    assert np.allclose(flat[0], (128 / 255 - imageprep.MEAN[0]) / imageprep.DEVIATION[0], atol=1e-6)
    rows = spark.createDataFrame([("p", png(pixels)), ("x", b"\x89PNG\r\n\x1a\njunk"), ("n", None)], "path string, content binary")
    tensors = imageprep.image_tensors(rows)
    got = {r.path: r for r in tensors.collect()}
    assert len(got["p"].tensor) == 3 * 224 * 224 and got["x"].error and got["n"].error
    vectors = {r.path: r for r in embed.embedded(tensors, embed.stand_in).collect()}
    assert len(vectors["p"].embedding) == 512 and vectors["x"].embedding is None
    broken = {r.path: r for r in embed.embedded(tensors, embed.onnx_provider("/no/model.onnx", (3, 224, 224))).collect()}
    assert broken["p"].error
    with pytest.raises(ValueError, match="cap"):
        imageprep.decode_image(png(pixels), cap=1000)
