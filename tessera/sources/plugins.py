"""Classes from files, for models that are given by path."""

from __future__ import annotations

import importlib.util
import inspect
from pathlib import Path


def load_class(path: str, base: type) -> type:
    """The first class that a file itself defines below base and that isn't abstract."""
    name = Path(path).stem
    spec = importlib.util.spec_from_file_location(name, path)
    if spec is None or spec.loader is None:
        raise ImportError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for c in vars(module).values():
        if inspect.isclass(c) and issubclass(c, base) and c is not base and c.__module__ == name and not inspect.isabstract(c):
            return c
    raise LookupError(f"{path} has no class below {base.__name__}")
