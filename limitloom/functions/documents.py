"""Reading documents whose shape varies from row to row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document(text: Column | str) -> Column:
    """A JSON text as a variant value; missing where the text is no JSON."""
    return F.try_parse_json(text)


def at_path(doc: Column | str, path: str, kind: str) -> Column:
    """The value at ``path`` (``$.a.b[0]``) as ``kind``; missing where the path is absent or holds something else."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)
