"""Small JSON states, and settings; a broken file is an empty state."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def read_state(path: str, lists: tuple[str, ...] = ("baseline", "imported", "quarantined")) -> dict[str, list[str]]:
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    return {k: sorted({str(x) for x in v}) if isinstance(v := data.get(k), list) else [] for k in lists}


def write_state(path: str, state: dict[str, list[str]]) -> None:
    """Sorted sets; the file is replaced as a whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{os.getpid()}"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump({k: sorted(set(v)) for k, v in state.items()}, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def known_keys(spark: SparkSession, state: dict[str, list[str]]) -> DataFrame:
    """key, status of everything in a state."""
    return spark.createDataFrame([(k, s) for s, keys in state.items() for k in keys], "key string, status string")


def _positive(value: str | None, default: int) -> int:
    try:
        n = int(value) if value is not None else default
    except ValueError:
        return default
    return n if n > 0 else default


@dataclass(frozen=True)
class Settings:
    """What a run uses: argument, else environment variable SKRIVA_*, else default; bad numbers fall back."""

    root: str = "."
    project: str | None = None
    limit: int = 8
    budget: int = 2000
    chunk_tokens: int = 400
    overlap: int = 40
    include: tuple[str, ...] = field(default_factory=tuple)
    exclude: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def resolve(env: dict[str, str] | None = None, **given: object) -> Settings:
        env = dict(os.environ) if env is None else env
        base = Settings()
        values: dict[str, object] = {}
        for name in ("root", "project"):
            values[name] = given.get(name) or env.get(f"SKRIVA_{name.upper()}") or getattr(base, name)
        for name in ("limit", "budget", "chunk_tokens", "overlap"):
            own = given.get(name)
            values[name] = own if isinstance(own, int) and own > 0 else _positive(env.get(f"SKRIVA_{name.upper()}"), getattr(base, name))
        for name in ("include", "exclude"):
            own = given.get(name)
            raw = own if own is not None else [x for x in env.get(f"SKRIVA_{name.upper()}", "").split(",") if x]
            cleaned = (str(x).replace("\\", "/").strip().strip("/") for x in raw)
            values[name] = tuple(dict.fromkeys(x for x in cleaned if x))
        return Settings(**values)


def inside(root: str, path: str) -> str:
    """The absolute path of a note; a path that leads out of the root is refused."""
    full = os.path.realpath(os.path.join(root, path))
    base = os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path!r} leads out of the notes")
    return full
