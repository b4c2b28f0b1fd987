"""Semi-structured values (P7, J8, S3): JSON text held as Spark VARIANT.

``v:a.b::type`` becomes ``variant_get(v, '$.a.b', type)``.  A missing path
or JSON null gives NULL; a value that does not cast raises (strict, the
default) or gives NULL (lenient, ``try_variant_get``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse(text, strict: bool = True) -> Column:
    """JSON text -> VARIANT; malformed text raises, or gives NULL if lenient."""
    return F.parse_json(_c(text)) if strict else F.try_parse_json(_c(text))


def get(v, path: str, type_: str, strict: bool = True) -> Column:
    """Typed extraction of a JSON path (``v:a.b::type``)."""
    if not path.startswith("$"):
        path = "$." + path
    return F.variant_get(_c(v), path, type_) if strict else F.try_variant_get(_c(v), path, type_)


def flatten(df: DataFrame, v, path: str, outer: bool = False, pos: str = "pos", value: str = "value") -> DataFrame:
    """``LATERAL FLATTEN(input => v:path)`` (J8): one row per array element.

    Keeps every input column and adds ``pos`` (0-based index) and ``value``
    (VARIANT).  An empty or missing array yields no row unless ``outer``.
    A generator inside the scan's stage: no shuffle.
    """
    arr = get(v, path, "array<variant>")
    gen = F.posexplode_outer(arr) if outer else F.posexplode(arr)
    return df.select("*", gen.alias(pos, value))
