"""Column functions on their own cases."""

import base64
import math

import pytest
from pyspark.sql import functions as F

from mediafold.functions import headers, mel, metadata, sniff, text
from mediafold.operators import vocabulary


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_sniff(spark):
    cases = {
        b"\xff\xd8": "image/jpeg", b"\x89PNG\r\n\x1a\n": "image/png", b"\x89PNG": None, b"GIF89a": "image/gif", b"BM": "image/bmp", b"fLaC": "audio/flac", b"OggS": "audio/ogg", b"ID3": "audio/mpeg",
        b"\xff\xfb\x90": "audio/mpeg", b"\xff\xfeA": "audio/mpeg", b"\xff\x1f": None, b"RIFF\0\0\0\0WAVE": "audio/wav", b"RIFF\0\0\0\0WEBP": "image/webp", b"RIFF\0\0\0\0AVI ": "video/avi", b"RIFF\0\0\0\0WAV": None,
        b"\x1aE\xdf\xa3": "video/x-matroska", b"II*\0": "image/tiff", b"MM\0*": "image/tiff", b"\0\0\0\x18ftypM4A ": "audio/mp4", b"\0\0\0\x18ftypM4B ": "audio/mp4", b"\0\0\0\x18ftypavis": "image/avif",
        b"\0\0\0\x18ftypmif1": "image/heic", b"\0\0\0\x18ftypisom": "video/mp4", b"\0\0\0\x18ftyp": None, b"": None, b"text": None, None: None,
    }
    assert column(spark, list(cases), "binary", sniff.mime_of) == list(cases.values())


def test_dims(spark):
    vp8l = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little")
    vp8x = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (11).to_bytes(4, "big")
    # every WebP form takes 30 bytes, and a PNG's first chunk must be its header
    cases = [png, vp8x, vp8l + bytes(5), vp8l + bytes(4), png.replace(b"IHDR", b"IDAT"), png[:20], b"GIF89a", None]
    got = column(spark, cases, "binary", headers.image_dims)
    assert [r and tuple(r) for r in got] == [(7, 11), (640, 480), (100, 50), None, None, None, None, None]


def test_humanize(spark):
    cases = {
        "a/b/Door_Slam-02.wav": "door slam", "fooBar.mp3": "foo bar", "FOOBar.x": "foobar", "a1B.wav": "ab", "12.wav": "sound", ".wav": "sound", "x/": "sound", "many   spaces__x.y.z": "many spaces x.y", "Éa.wav": "Éa", "noext": "noext",
    }
    assert column(spark, list(cases), "string", text.humanize) == list(cases.values())


def test_descriptions_and_cleaning(spark):
    assert column(spark, [["wind", "rain", "sea", "sky"], [], ["élan"]], "array<string>", text.describe_tags) == ["Wind, rain, sea.", ".", "Élan."]
    assert column(spark, [["a ", " \t", " b ", None]], "array<string>", text.clean_tags) == [["a", "b"]]
    assert column(spark, ["ab", "abc", "é😀x"], "string", lambda c: text.truncated(c, 2)) == ["ab", "ab…", "é😀…"]
    assert column(spark, ["http://h/v1//", "x"], "string", text.chat_url) == ["http://h/v1/chat/completions", "x/chat/completions"]
    assert column(spark, ["a\nb\nc\nd\ne\nf\n", "a"], "string", text.last_lines) == ["b\nc\nd\ne\nf", "a"]
    data = bytes(range(256)) * 3
    assert column(spark, [data], "binary", lambda c: text.data_url(F.lit("image/png"), c)) == ["data:image/png;base64," + base64.b64encode(data).decode()]


def test_path_order(spark):
    df = spark.createDataFrame([("a-b",), ("a/b",), ("a",), ("a/b/c",)], "p string")
    assert [r.p for r in df.orderBy(text.path_order(F.col("p"))).collect()] == ["a", "a/b", "a/b/c", "a-b"]


def test_short_values(spark):
    kept = spark.createDataFrame([({"a": "x" * 512, "b": "é" * 257, "c": ""},)], "m map<string,string>").select(F.map_keys(metadata.short_values(F.col("m")))).first()[0]
    assert sorted(kept) == ["a", "c"]


def test_mel_round_trip(spark):
    hz = [50.0, 440.0, 999.0, 1000.0, 8000.0, 14000.0]
    again = column(spark, hz, "double", lambda c: mel.mel_to_hz(mel.hz_to_mel(c)))
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(hz, again, strict=True))


def test_labels(spark):
    assert vocabulary.parse_labels("a, b,,c ") == ["a", "b", "c"] and vocabulary.parse_labels() is None
    assert vocabulary.parse_labels(text="# head\ncat # meow\n\ndog\n") == ["cat", "dog"]
    for bad in ({"inline": " , "}, {"inline": "one"}, {"inline": "a,b", "text": "c\nd"}):
        with pytest.raises(ValueError):
            vocabulary.parse_labels(**bad)
    key = vocabulary.cache_key("m", ["a", "b"])
    assert len({key, vocabulary.cache_key("m", ["b", "a"]), vocabulary.cache_key("n", ["a", "b"]), vocabulary.cache_key("m", ["ab"])}) == 4
    df = spark.createDataFrame([("m", ["a", "b"])], "m string, l array<string>")
    assert df.select(vocabulary.cache_key_column(F.col("m"), F.col("l"))).first()[0] == key
