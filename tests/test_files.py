"""Listing, the file pipeline, sinks, the command line and the stream, on temporary directories."""

import json
import os
import re

import numpy as np
import pytest

from mediafold import cli
from mediafold.functions.text import path_order
from mediafold.operators.embed import stand_in
from mediafold.operators.endpoint import Endpoint
from mediafold.operators.zeroshot import LOOSE
from mediafold.operators.taggers import AUDIO_LABELS, IMAGE_LABELS, TOWERS, Tagger, TaggerUnavailable, label_matrix, load_tagger
from mediafold.plans.describe import Settings, describe
from mediafold.sources import external, listing
from mediafold.sources.media import Attach, Programs
from mediafold.sources.sidecars import SUFFIX, write_sidecars
from mediafold.streaming.files import append_facts, arriving
from tests.test_operators import answer, png, wav


@pytest.fixture
def tree(tmp_path):
    pixels = np.zeros((40, 64, 3), np.uint8)
    (tmp_path / "nested" / "deeper").mkdir(parents=True)
    (tmp_path / "b.wav").write_bytes(wav(np.sin(np.arange(48_000) / 20)))
    (tmp_path / "nested" / "Big_Door-1.png").write_bytes(png(pixels))
    (tmp_path / "nested" / "deeper" / ".hidden.wav").write_bytes(wav(np.zeros(4800)))
    (tmp_path / "_empty").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("not media")
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nxxxx")
    os.symlink(tmp_path, tmp_path / "loop")
    return tmp_path


def names(paths, tree):
    return [os.path.relpath(p, tree) for p in paths]


def test_walk(tree):
    found = listing.walk([str(tree)])
    assert names(found, tree) == ["_empty", "b.wav", "broken.png", "nested/Big_Door-1.png", "nested/deeper/.hidden.wav", "notes.txt"]
    assert names(listing.walk([str(tree / "loop")]), tree)[0] == "loop/_empty" and len(listing.walk([str(tree)] * 2)) == 12
    with pytest.raises(listing.InputError):
        listing.walk([str(tree / "none")])


def test_facts_and_skips(spark, tree):
    files = listing.local_files(spark, listing.walk([str(tree)]) + [str(tree / "gone")])
    rows = {os.path.relpath(r.path, tree): r for r in listing.with_kind(files).collect()}
    assert sorted(rows) == ["b.wav", "broken.png", "nested/Big_Door-1.png", "nested/deeper/.hidden.wav"]
    assert rows["b.wav"].type == "audio" and len(rows["b.wav"].sha256) == 64 and rows["b.wav"].bytes == (tree / "b.wav").stat().st_size
    assert sorted(names([r.path for r in listing.skipped(files).collect()], tree)) == ["_empty", "gone", "notes.txt"]
    stored = {os.path.basename(r.path): r.sha256 for r in listing.with_kind(listing.stored_files(spark, str(tree / "nested"))).collect()}
    assert stored["Big_Door-1.png"] == rows["nested/Big_Door-1.png"].sha256


def tagger(kind):
    matrix = np.random.default_rng(0).normal(size=(5, 512))
    return Tagger(["one", "two", "three", "four", "five"], matrix / np.linalg.norm(matrix, axis=1, keepdims=True), stand_in, LOOSE, f"{kind} model")


def test_records_with_local_tags(spark, tree):
    settings = Settings(tagger("image"), tagger("audio"))
    rows = {os.path.relpath(r.path, tree): r for r in describe(spark, listing.walk([str(tree)]), settings).collect()}
    door, broken, hidden = rows["nested/Big_Door-1.png"], rows["broken.png"], rows["nested/deeper/.hidden.wav"]
    assert json.loads(door.metadata) == {"width": 64, "height": 40, "note": "exiftool not found; minimal metadata only"} and door.model == "image model"
    assert door.description == ((", ".join(door.tags[:3]) + ".").capitalize() if door.tags else "big door.")
    assert broken.clip_error and broken.description == "broken." and broken.model is None
    assert hidden.tags is None and hidden.description == ".hidden (short sound effect)." and hidden.model == "audio model" and hidden.clap_error is None
    sound = rows["b.wav"]
    assert sound.type == "audio" and json.loads(sound.metadata) == {"duration_s": 1.0, "sample_rate": 48000, "note": "ffprobe not found; minimal metadata only"} and sound.duration_ms >= 0


def test_records_with_an_endpoint(spark, tree):
    reply = lambda *_: answer('{"tags": ["far"], "description": "From afar.", "summary": "s"}')
    settings = Settings(tagger("image"), None, {"vision": Endpoint("u", "m")}, transport=reply)
    rows = {os.path.relpath(r.path, tree): r for r in describe(spark, listing.walk([str(tree)]), settings).collect()}
    assert (rows["broken.png"].tags, rows["broken.png"].model) == (["far"], "m")
    sound = rows["b.wav"]
    assert sound.error is None and sound.llm_error == "no endpoint configured for audio" and sound.type == "audio" and sound.sha256


def test_endpoint_gets_the_image_and_its_metadata(spark, tree, tmp_path_factory):
    log = str(tmp_path_factory.mktemp("asked"))

    def recording(url, body, key, timeout):
        with open(os.path.join(log, str(abs(hash(str(body["messages"][1]))))), "w") as f:
            json.dump(body["messages"][1]["content"], f)
        return answer('{"tags": ["far"]}')

    for vision in (True, False):
        describe(spark, [str(tree / "nested" / "Big_Door-1.png")], Settings(endpoints={"vision": Endpoint("u", "m")}, transport=recording, vision=vision)).collect()
    asked = sorted((json.load(open(os.path.join(log, x))) for x in os.listdir(log)), key=lambda c: isinstance(c, str))
    text = 'Image file.\nMetadata:\n{\n  "height": 40,\n  "note": "exiftool not found; minimal metadata only",\n  "width": 64\n}'
    assert asked[0][0] == {"type": "text", "text": text} and asked[0][1]["image_url"]["url"].startswith("data:image/png;base64,") and asked[1] == text
    os.remove(tree / "broken.png")
    files = listing.local_files(spark, [str(tree / "nested" / "Big_Door-1.png")])
    assert files.first().error is None


def test_an_image_that_cannot_be_attached_makes_an_error_row(spark):
    from mediafold.operators.endpoint import enrich
    from mediafold.operators.merge import merged

    rows = spark.createDataFrame([("/no/such.png", "vision", "p", "image/png", ["local"], "Local.")], "path string, modality string, prompt string, mime string, tags array<string>, description string")
    rows = rows.selectExpr("*", "'image' AS type", "CAST(NULL AS DOUBLE) AS duration_s", "CAST(NULL AS STRING) AS summary", "'local' AS model", "CAST(NULL AS STRING) AS llm_error", "CAST(NULL AS STRING) AS error")
    asked = enrich(rows, {"vision": Endpoint("u", "m")}, "ask", lambda *_: answer("{}"), attach=Attach())
    got = merged(rows.join(asked, "path")).first()
    assert got.error == "read for vision: No such file or directory" and got.tags is None and got.description is None


def test_sidecars(spark, tree):
    rows = describe(spark, listing.walk([str(tree)]))
    assert write_sidecars(rows) == 4 and write_sidecars(rows) == 4
    assert json.loads((tree / f"b.wav{SUFFIX}").read_text())["type"] == "audio"
    assert {p.name for p in tree.iterdir() if p.name.startswith("tmp")} == set()
    assert describe(spark, listing.walk([str(tree)])).count() == 4  # sidecars are no media


def test_command_line(spark, tree, capsys, tmp_path):
    assert cli.main(["--no-llm", "--json", "--quiet", str(tree)], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    assert [os.path.relpath(r["path"], tree) for r in rows] == ["b.wav", "broken.png", "nested/Big_Door-1.png", "nested/deeper/.hidden.wav"]
    assert cli.main(["--no-llm", "--json", "--quiet", str(tree / "b.wav")], spark) == 0 and json.loads(capsys.readouterr().out)["type"] == "audio"
    assert cli.main(["--no-llm", "--json", "--quiet", str(tree / "notes.txt")], spark) == 0 and json.loads(capsys.readouterr().out) == []
    assert cli.main(["--quiet", str(tree)], spark) == cli.NO_ENDPOINT and cli.main(["--quiet", "--no-llm", str(tree / "none")], spark) == cli.USAGE
    assert cli.main(["--quiet", "--no-llm", "--labels", "one", str(tree)], spark) == cli.USAGE
    for form in ("json", "markdown", "text"):
        assert cli.main(["--no-llm", "-q", "--format", form, str(tree)], spark) == 0
        printed = capsys.readouterr().out
        assert cli.main(["--no-llm", "-q", "--format", form, "-o", str(tmp_path / "document"), str(tree)], spark) == 0 and capsys.readouterr().out == ""
        plain = lambda t: re.sub(r'"?duration_ms"?: \d+', "", t).strip()
        assert plain((tmp_path / "document").read_text()) == plain(printed)
        os.remove(tmp_path / "document")
    assert cli.main(["--no-llm", "--json", str(tree)], spark) == 0
    assert [os.path.relpath(x.removeprefix("skipped: "), tree) for x in capsys.readouterr().err.splitlines() if x.startswith("skipped: ")] == ["_empty", "notes.txt"]
    assert cli.main(["--doctor"]) == 0 and "ffmpeg" in capsys.readouterr().out


def program(folder, name, script):
    """A program that answers as the script says."""
    path = folder / name
    path.write_text(f"#!/bin/sh\n{script}\n")
    path.chmod(0o755)
    return (str(path),)


def test_facts_of_programs_are_part_of_records(spark, tree, tmp_path_factory):
    folder = tmp_path_factory.mktemp("programs")
    (tree / "clip.mp4").write_bytes(b"\0\0\0\x18ftypisom" + bytes(20))
    (tree / "bad.avi").write_bytes(b"RIFF\0\0\0\0AVI " + bytes(20))
    probe = program(folder, "probe", """case "$1" in *bad*) echo no >&2; exit 1;; *.mp4) d=8.0;; *) d=0.2;; esac
echo '{"format":{"duration":"'$d'","tags":{"artist":"x"}},"streams":[{"codec_type":"video","codec_name":"h264","width":128,"height":96}]}'""")
    exif = program(folder, "exif", """echo '[{"SourceFile":"f","ImageWidth":64,"ISO":100}]'""")
    (folder / "frame.png").write_bytes(png(np.full((96, 128, 3), 200, np.uint8)))
    ffmpeg = program(folder, "ffmpeg", f"""for last; do :; done; echo "$@" >> {folder}/log; case "$last" in *.mp3) printf ID3sound > "$last";; *) cp {folder}/frame.png "$last";; esac""")
    sent = str(folder / "sent")
    os.mkdir(sent)

    def recording(url, body, key, timeout):
        with open(os.path.join(sent, body["messages"][1]["content"][0]["text"][:5]), "w") as f:
            json.dump(body["messages"][1]["content"], f)
        return answer('{"summary": "seen"}')

    programs = Programs(probe, exif, ffmpeg)
    endpoints = {m: Endpoint("u", "m") for m in ("vision", "audio", "video")}
    settings = Settings(tagger("image"), tagger("audio"), endpoints, transport=recording, audio=True, frames=2, programs=programs, tasks=2)
    rows = {os.path.relpath(r.path, tree): r for r in describe(spark, listing.walk([str(tree)]), settings).collect()}
    clip, door = rows["clip.mp4"], rows["nested/Big_Door-1.png"]
    assert json.loads(clip.metadata) == {"duration_s": 8.0, "format_tags": {"artist": "x"}, "codec": "h264", "width": 128, "height": 96, "fps": None}
    assert clip.clip_error is None and clip.description and clip.summary == "seen" and clip.model == "m" and clip.duration_ms > 0
    assert json.loads(door.metadata) == {"width": 64, "exif": {"ImageWidth": 64, "ISO": 100}}
    bad = rows["bad.avi"]
    assert bad.error.endswith("no") and (bad.sha256, bad.metadata, bad.type) == (None, None, None)
    assert rows["b.wav"].description == "b (short sound effect)." and rows["b.wav"].summary == "seen"
    log = (folder / "log").read_text()
    assert all(f"-ss {t} " in log for t in ("4.000", "2.000", "6.000")) and "-ar 16000" in log
    video = json.load(open(os.path.join(sent, "Video")))
    assert video[0]["text"].startswith("Video (sample frames attached).\nMetadata:") and "artist" not in video[0]["text"] and len(video) == 3
    assert json.load(open(os.path.join(sent, "Audio")))[1]["input_audio"]["format"] == "mp3"
    plain = {os.path.relpath(r.path, tree): r for r in describe(spark, [str(tree / "clip.mp4")], Settings(tagger("image"), None, {"video": Endpoint("u", "m")}, transport=recording)).collect()}
    assert "ffmpeg not found" in plain["clip.mp4"].error  # its frames can't be sent
    alone = describe(spark, [str(tree / "clip.mp4")], Settings(tagger("image"))).first()
    assert "ffmpeg not found" in alone.clip_error and alone.description == "clip." and alone.error is None


def test_label_vectors_are_kept_by_their_key(tmp_path):
    asked = []

    def embed(labels):
        asked.append(list(labels))
        return np.array([[len(x), 1.0, -1.0] for x in labels])

    tower = TOWERS["image"]
    first = label_matrix(tower, ["a", "bcd", "ef"], tmp_path, embed, 3)
    assert np.allclose(np.square(first).sum(axis=1), 1) and np.allclose(label_matrix(tower, ["a", "bcd", "ef"], tmp_path, embed, 3), first) and len(asked) == 1
    label_matrix(tower, ["bcd", "a", "ef"], tmp_path, embed, 3)  # another order, another key
    (file,) = [f for f in tmp_path.iterdir() if np.frombuffer(f.read_bytes(), "<f4").tolist() == first.ravel().tolist()]
    file.write_bytes(file.read_bytes()[:-1])
    assert np.allclose(label_matrix(tower, ["a", "bcd", "ef"], tmp_path, embed, 3), first) and len(asked) == 3
    sound = label_matrix(TOWERS["audio"], ["a", "bcd"], tmp_path, embed, 3)
    assert np.allclose(sound, np.array([[1, 1, -1], [3, 1, -1]]) / np.sqrt([[3], [11]]))  # not centred
    for wrong in (lambda labels: np.zeros((1, 3)), lambda labels: 1 / 0, None):
        with pytest.raises(TaggerUnavailable):
            label_matrix(tower, ["x", "y"], tmp_path / "none", wrong, 3)
    blocked = tmp_path / "file"
    blocked.write_text("")
    assert label_matrix(tower, ["q", "rr"], blocked, embed, 3).shape == (2, 3)  # can't be kept
    with pytest.raises(TaggerUnavailable):
        load_tagger("image", None, {"MEDIAFOLD_CACHE": str(tmp_path)})
    assert len(set(IMAGE_LABELS)) == len(set(AUDIO_LABELS)) == 50


def test_taggers_on_the_command_line(spark, tree, capsys, monkeypatch):
    def load(kind, labels):
        matrix = np.random.default_rng(1).normal(size=(len(labels or "ab"), 512))
        return Tagger(labels or ["a", "b"], matrix, stand_in, LOOSE, f"{kind} model")

    run = lambda *args: (cli.main(["--no-llm", "--json", "-q", *args, str(tree)], spark, load), capsys.readouterr().out)
    code, out = run("--clip", "--clap", "--labels", "red, green,blue", "-c", "3")
    rows = {os.path.relpath(r["path"], tree): r for r in json.loads(out)}
    assert code == 0 and set(rows["nested/Big_Door-1.png"].get("tags", [])) <= {"red", "green", "blue"} and rows["b.wav"]["model"] == "audio model"
    assert rows["nested/deeper/.hidden.wav"]["description"] == ".hidden (short sound effect)."
    monkeypatch.setenv("MEDIAFOLD_MIN_SECONDS", "0.05")
    assert "short" not in json.loads(run("--clap")[1])[-1]["description"]
    assert run("--labels", "a,b")[0] == cli.USAGE
    monkeypatch.setenv("MEDIAFOLD_CACHE", str(tree))
    assert cli.main(["--no-llm", "-q", "--clip", str(tree)], spark) == cli.NO_TAGGER


def test_programs(spark):
    with pytest.raises(external.ProgramError, match="is it installed"):
        external.run_program(["no-such-program"], 5)
    with pytest.raises(external.ProgramError, match="took over"):
        external.run_program(["sleep", "5"], 0.2)
    with pytest.raises(external.ProgramError) as e:
        external.run_program(["sh", "-c", "for i in 1 2 3 4 5 6 7; do echo line$i >&2; done; exit 3"], 5)
    assert "line7" in str(e.value) and "line2" not in str(e.value)


def test_stream_appends_each_file_once(spark, tree, tmp_path_factory):
    out, check = (str(tmp_path_factory.mktemp("stream") / x) for x in ("table", "checkpoint"))
    for n in (1, 2):
        (tree / "nested" / f"new{n}.wav").write_bytes(wav(np.zeros(100 * n)))
        append_facts(arriving(spark, str(tree / "nested")), out, check).awaitTermination()
        got = sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())
        assert got == ["Big_Door-1.png", *(f"new{k}.wav" for k in range(1, n + 1))]


def test_order_is_by_component(spark, tree):
    rows = describe(spark, listing.walk([str(tree)]))
    assert [r.path for r in rows.orderBy(path_order(rows.path)).collect()] == [p for p in listing.walk([str(tree)]) if not p.endswith(("_empty", "notes.txt"))]
