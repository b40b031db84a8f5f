"""Files in the shared folder that workers open themselves: memory-mapped arrays."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np

from evq.session import scratch_path


def mounted_folder(spark, name: str) -> str:
    """A new folder below the session's shared folder, as a path that every worker can open.

    Memory mapping needs a mounted file system (NFS, Lustre, a FUSE mount, ...); a store that only Hadoop clients
    reach is refused here, before any work starts.
    """
    base = urlsplit(scratch_path(spark, name))
    if base.scheme not in ("", "file"):
        raise ValueError(f"{name}: memory-mapped arrays need spark.checkpoint.dir on a mounted path, not {base.scheme}:")
    path = unquote(base.path)
    os.makedirs(path)
    return path


def save_array(path: str, values: np.ndarray) -> None:
    """Write one .npy file in one step: a task that runs twice leaves the same file, never half of one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, np.ascontiguousarray(values))
    os.replace(part, path)


def open_array(path: str) -> np.ndarray:
    if os.path.getsize(path) <= 128:  # an empty array cannot be mapped
        return np.load(path)
    return np.load(path, mmap_mode="r")
