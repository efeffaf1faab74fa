"""Settings of flows: JSON with ``${NAME}`` for variables."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

VARIABLE = re.compile(r"\$\$|\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def substituted(value: Any, variables: Mapping[str, str]) -> Any:
    """``value`` with its variables filled in, in all strings of lists and dictionaries.

    ``${NAME:-text}`` has a default, ``$$`` is a dollar sign; a variable without either is an error.
    """
    if isinstance(value, dict):
        return {k: substituted(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        if m[1] not in variables and m[2] is None:
            raise KeyError(f"no variable {m[1]!r}")
        return variables.get(m[1], m[2])

    return VARIABLE.sub(fill, value)


def load(text: str, variables: Mapping[str, str]) -> Any:
    return substituted(json.loads(text), variables)
