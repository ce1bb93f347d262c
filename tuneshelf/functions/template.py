"""Render a ``{name}`` template as one ``concat`` of literals and string Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **fields: Column | str) -> Column:
    """``concat`` keeps null semantics: a null field makes the whole text null,
    so callers pass already-defaulted columns."""
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        value = fields[m.group(1)]
        parts.append(F.col(value) if isinstance(value, str) else value)
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
