"""Settings of an index: environment over file over defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from importlib import import_module
from pathlib import Path

from .functions.scalar import DEFAULT_EXCLUDES

FOLDER = ".weftgraph"
_ENV = {"model_key": "OPENAI_API_KEY", "model_name": "OPENAI_MODEL", "model": "WEFTGRAPH_MODEL", "embedder": "WEFTGRAPH_EMBEDDER"}


def _imported(name: str):
    module, _, what = name.partition(":")
    return getattr(import_module(module), what)


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    max_body_lines: int = 0
    content_only: bool = False
    emit_calls: bool = False
    all_imports: bool = False
    model_key: str = ""
    model_name: str = ""
    #: Where a model that explains is imported from, and one that embeds: "package.module:function".
    model: str = ""
    embedder: str = ""
    excludes: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        for name, env in _ENV.items():
            if value := os.environ.get(env):
                object.__setattr__(self, name, value)
        object.__setattr__(self, "excludes", tuple(dict.fromkeys((*DEFAULT_EXCLUDES, *self.exclude))))

    def explainer(self) -> Callable[[str, str], str] | None:
        """``model`` as a function of system and user prompt; it is made with the key and the name of the model if it is a class. None if none is set."""
        if not self.model:
            return None
        found = _imported(self.model)
        return found(self.model_key, self.model_name) if isinstance(found, type) else found

    def embed(self) -> Callable | None:
        """``embedder`` as a function from a text column to a vector column; None for the default."""
        return _imported(self.embedder) if self.embedder else None

    def options(self) -> dict:
        """What the parsers are told."""
        return {"max_body_lines": self.max_body_lines, "emit_calls": self.emit_calls, "all_imports": self.all_imports}

    @classmethod
    def load(cls, root: str | Path, **given) -> Config:
        """The file ``config.toml`` in the index folder of ``root``, where there is one, under what is given."""
        path = Path(root) / FOLDER / "config.toml"
        read = tomllib.loads(path.read_text()) if path.is_file() else {}
        known = {f.name for f in fields(cls) if f.init}
        found = {k: tuple(v) if isinstance(v, list) else v for k, v in read.items() if k in known}
        return cls(**{**found, **{k: v for k, v in given.items() if v is not None}})


def prepare_folder(root: str | Path) -> Path:
    """The index folder of a project, made if need be, and named in the project's .gitignore if that exists."""
    folder = Path(root) / FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    ignore = Path(root) / ".gitignore"
    if ignore.is_file():
        text = ignore.read_text()
        if f"{FOLDER}/" not in text.split():
            ignore.write_text(text + ("" if text.endswith("\n") or not text else "\n") + f"{FOLDER}/\n")
    return folder


def exists(root: str | Path) -> bool:
    """Whether a whole build is stored in the project's index folder."""
    return (Path(root) / FOLDER / "current").exists()
