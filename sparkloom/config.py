"""A project's configuration: sources and defaults in YAML, variables from the environment and a .env file."""

from __future__ import annotations

import os
import re

from .plans.tree import DialectError
from .session import Engine
from .sources import Spec
from .sources.files import expanded

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")
#: Options whose values must come from a variable, so that they stand in no file.
SECRET = frozenset("password token bearer api_key key secret sas header_authorization".split())


def dotenv(path: str) -> dict[str, str]:
    out = {}
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    v = m[2]
                    out[m[1]] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else re.sub(r"\s+#.*$", "", v)
    return out


def filled(value: object, variables: dict[str, str]) -> object:
    """${NAME} and ${NAME:-default} replaced, in texts at any depth; a name without a value or default is an error."""
    if isinstance(value, dict):
        return {k: filled(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in variables:
            return variables[m[1]]
        if m[2] is None:
            raise DialectError(f"variable {m[1]} isn't set")
        return m[2]

    return _VARIABLE.sub(one, value)


def check_secrets(name: str, options: dict) -> None:
    for k, v in options.items():
        if k.lower() in SECRET and isinstance(v, str) and v and not _VARIABLE.search(v):
            raise DialectError(f"source {name}: {k} must be a variable, as ${{NAME}}")


def load(engine: Engine, path: str) -> dict:
    """Registers a file's sources; returns its defaults."""
    import yaml

    base = os.path.dirname(os.path.abspath(path))
    with open(path) as f:
        said = yaml.safe_load(f) or {}
    variables = {**dotenv(os.path.join(base, ".env")), **os.environ}
    engine.base = base
    items = said.get("sources") or {}
    for name, s in items.items() if isinstance(items, dict) else [(x.pop("name"), x) for x in items]:
        s = dict(s)
        check_secrets(name, s.get("options") or s)
        s = filled(s, variables)
        prefix = s.pop("connector", None) or s.pop("prefix", None) or s.pop("type", None)
        where = s.pop("path", None) or s.pop("source", None) or s.pop("url", None) or s.pop("dsn", None) or ""
        options = {**(s.pop("options", None) or {}), **s}
        if not prefix:
            prefix, _, where = where.partition(":")
        for n, spec in expanded(engine.spark, name, Spec(prefix, str(where), {k: str(v) for k, v in options.items()}), base).items():
            engine.register(n, spec)
    engine.reload()
    return said.get("defaults") or {}
