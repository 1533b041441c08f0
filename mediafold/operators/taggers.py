"""Local taggers: default vocabularies, label vectors from a cache or a text model, and model files in the cache folder.

Nothing is downloaded. A model, its text model and its tokenizer are files of these names in the cache folder; what isn't there makes the tagger unavailable.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from mediafold.operators.dsp import BANDS
from mediafold.operators.embed import DIMENSIONS, Provider, onnx_provider
from mediafold.operators.endpoint import PREFIX, setting
from mediafold.operators.imageprep import SIDE
from mediafold.operators.vocabulary import cache_key
from mediafold.operators.zeroshot import AUDIO, IMAGE, Gate

# The default vocabularies.
IMAGE_LABELS = (
    "normal map", "mask map", "tiling texture", "sprite sheet", "icon", "user interface", "pixel art", "concept art", "3d render", "logo", "screenshot", "diagram", "person", "face", "character", "crowd", "animal",
    "creature", "robot", "vehicle", "aircraft", "spaceship", "boat", "building", "interior", "city", "landscape", "forest", "water", "sky", "mountain", "space", "dungeon", "weapon", "armor", "tool", "furniture", "food",
    "plant", "container", "potion", "coin", "book", "machine", "sign", "dark", "bright", "colorful", "monochrome", "transparent",
)
AUDIO_LABELS = (
    "tense", "heroic", "somber", "triumphant", "ominous", "peaceful", "melancholic", "energetic", "mysterious", "playful", "epic", "eerie", "orchestral", "electronic", "military march", "ambient", "rock", "chiptune",
    "cinematic", "industrial", "folk", "synthwave", "brass", "strings", "percussion", "synth", "piano", "choir", "drums", "impact", "whoosh", "explosion", "gunshot", "laser", "sword clash", "footstep", "door creak",
    "button click", "notification chime", "construction", "mechanical", "magic spell", "creature roar", "scream", "laughter", "crowd", "water splash", "wind", "fire crackle", "glass break",
)

TextEmbedder = Callable[[Sequence[str]], np.ndarray]


class TaggerUnavailable(RuntimeError):
    """A model or the vectors of its labels are not there."""


@dataclass(frozen=True)
class Tagger:
    labels: list[str]
    matrix: np.ndarray
    provider: Provider
    gate: Gate
    name: str


@dataclass(frozen=True)
class Tower:
    """Files of a model, and how its label texts are prepared. width: token ids a text, or None for that of the longest."""

    kind: str
    name: str
    model_file: str
    text_file: str
    tokenizer_file: str
    shape: tuple[int, ...]
    gate: Gate
    labels: tuple[str, ...]
    width: int | None
    centred: bool


# File names, widths and which tower's labels are centred.
TOWERS = {
    "image": Tower("image", "clip (local)", "clip_image.onnx", "clip_text.onnx", "clip_tokenizer.json", (3, SIDE, SIDE), IMAGE, IMAGE_LABELS, 77, True),
    "audio": Tower("audio", "clap (local)", "clap_audio.onnx", "clap_text.onnx", "clap_tokenizer.json", (1, 1001, BANDS), AUDIO, AUDIO_LABELS, None, False),
}


def cache_dir(env: Mapping[str, str] | None = None) -> Path:
    env = os.environ if env is None else env
    return Path(setting(env, f"{PREFIX}_CACHE") or Path(env.get("HOME", "."), ".cache", "mediafold"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of length 0 is unchanged."""
    n = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1, keepdims=True))
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def text_embedder(tower: Tower, folder: Path) -> TextEmbedder:
    """The text model of the cache folder: token ids alone are its input, filled up with 0."""

    def embed(labels: Sequence[str]) -> np.ndarray:
        import onnxruntime
        from tokenizers import Tokenizer

        ids = [e.ids for e in Tokenizer.from_file(str(folder / tower.tokenizer_file)).encode_batch(list(labels))]
        width = tower.width or max(map(len, ids))
        filled = np.zeros((len(ids), width), np.int64)
        for row, own in zip(filled, ids, strict=True):
            row[: min(width, len(own))] = own[:width]
        session = onnxruntime.InferenceSession(str(folder / tower.text_file))
        return session.run(["text_embeds"], {"input_ids": filled})[0]

    return embed


def label_matrix(tower: Tower, labels: Sequence[str], folder: Path, embed: TextEmbedder | None = None, dim: int = DIMENSIONS) -> np.ndarray:
    """The labels' unit vectors: from the cache if the file has as many bytes as these labels need, else computed and kept. A cache that can't be written is no failure."""
    cached = folder / f"labels-{cache_key(tower.text_file, labels)}.bin"
    try:
        data = cached.read_bytes()
        if len(data) == 4 * dim * len(labels):
            return np.frombuffer(data, "<f4").reshape(len(labels), dim)
    except OSError:
        pass
    if embed is None and not (folder / tower.text_file).exists():
        raise TaggerUnavailable(f"{tower.name}: no {cached.name} and no {tower.text_file} in {folder}")
    try:
        x = np.asarray((embed or text_embedder(tower, folder))(labels), np.float32)
    except Exception as e:  # noqa: BLE001  whatever the model says
        raise TaggerUnavailable(f"{tower.name}: {e}") from e
    if x.shape != (len(labels), dim):
        raise TaggerUnavailable(f"{tower.name}: the text model gave {x.size} numbers, not {len(labels) * dim}")
    x = unit_rows(x)
    if tower.centred:
        x = unit_rows(x - x.mean(axis=0, dtype=np.float64))
    try:
        folder.mkdir(parents=True, exist_ok=True)
        beside = cached.with_suffix(f".{os.getpid()}")
        beside.write_bytes(x.astype("<f4").tobytes())
        os.replace(beside, cached)
    except OSError:
        pass
    return x


def load_tagger(kind: str, labels: Sequence[str] | None = None, env: Mapping[str, str] | None = None) -> Tagger:
    """The tagger of a kind (image or audio) with these labels or its own. Raises TaggerUnavailable."""
    tower, folder = TOWERS[kind], cache_dir(env)
    model = folder / tower.model_file
    if not model.exists():
        raise TaggerUnavailable(f"{tower.name}: {model} is not there")
    names = list(labels or tower.labels)
    return Tagger(names, label_matrix(tower, names, folder), onnx_provider(str(model), tower.shape), tower.gate, tower.name)
