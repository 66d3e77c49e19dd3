"""A snapshot of the environment of a run; values that may be secrets are masked."""

from __future__ import annotations

import os
import platform
import subprocess
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import SparkSession

#: Prefixes of environment variables that are recorded, and parts of names whose values are masked.
PREFIXES = ("SPARK_", "PYSPARK_", "CUDA_", "HF_", "TOKENIZERS_", "OMP_", "PYTHON")
SECRET = ("TOKEN", "KEY", "SECRET", "PASSWORD", "AUTH")


def _said(*command: str) -> str | None:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def snapshot(spark: SparkSession | None = None) -> dict:
    env = {k: "***" if any(s in k for s in SECRET) else v for k, v in sorted(os.environ.items()) if k.startswith(PREFIXES)}
    out = {
        "captured_at": datetime.now(timezone.utc).isoformat(),
        "platform": platform.platform(),
        "python": platform.python_version(),
        "packages": sorted(f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions()),
        "git_commit": _said("git", "rev-parse", "HEAD"),
        "git_dirty": bool(_said("git", "status", "--porcelain")),
        "gpu": _said("nvidia-smi", "--query-gpu=name,memory.total,driver_version", "--format=csv,noheader"),
        "env": env,
    }
    if spark is not None:
        conf = spark.sparkContext.getConf().getAll()
        out |= {"spark": spark.version, "spark_conf": {k: "***" if any(s in k.upper() for s in SECRET) else v for k, v in sorted(conf)}}
    return out
