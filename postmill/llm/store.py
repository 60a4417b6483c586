"""Plain numpy arrays as files of a shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def write(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task may overwrite what an earlier one left."""
    path = _local(folder)
    if path is None:
        system, base = fs.FileSystem.from_uri(folder)
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(array.tobytes())
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{path}/{name}")


def read(folder: str, name: str, dtype) -> np.ndarray:
    """The array, mapped where the shared folder is mounted; read whole from any other store."""
    path = _local(folder)
    if path is None:
        system, base = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{base}/{name}") as source:
            return np.frombuffer(source.read(), dtype)
    file = f"{path}/{name}"
    return np.memmap(file, dtype, "r").view(np.ndarray) if os.path.getsize(file) else np.zeros(0, dtype)
