"""Embedding providers: a column that is there already, an ONNX model if its file is there, and a deterministic stand-in for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIMENSIONS = 512
Provider = Callable[[np.ndarray], np.ndarray]


@lru_cache(maxsize=2)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path)


def onnx_provider(path: str, shape: tuple[int, ...], dimensions: int = DIMENSIONS) -> Provider:
    """A model with one input; one session for each Python worker. No weights are part of this repository, so only its errors are tested."""

    def embed(tensor: np.ndarray) -> np.ndarray:
        session = _session(path)
        out = session.run(None, {session.get_inputs()[0].name: tensor.reshape(1, *shape).astype(np.float32)})[0].ravel()
        if len(out) < dimensions:
            raise ValueError(f"the model gave {len(out)} numbers, not {dimensions}")
        return out[:dimensions]

    return embed


def stand_in(tensor: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A vector that depends on the tensor alone."""
    seed = int.from_bytes(hashlib.sha256(np.ascontiguousarray(tensor, np.float32).tobytes()).digest()[:8], "little")
    return np.random.default_rng(seed).standard_normal(dimensions).astype(np.float32)


def embedded(tensors: DataFrame, provider: Provider, id_col: str = "path") -> DataFrame:
    """``id_col``, embedding (null where the tensor is null or fails) and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    vectors.append(None if t is None else provider(np.array(t, np.float32)).tolist())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model says becomes the row's error
                    vectors.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["id", "embedding", "error"])

    kind = tensors.schema[id_col].dataType.simpleString()
    return tensors.selectExpr(f"`{id_col}` AS id", "tensor").mapInArrow(run, f"id {kind}, embedding array<float>, error string").withColumnRenamed("id", id_col)
