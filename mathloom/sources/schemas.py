"""Explicit schemas of every table that is read from files."""

from __future__ import annotations

from pyspark.sql import types as T

_text = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, _text) for name in names])


GT_EXTRACT = _strings("id", "latex")
PREDICTIONS = _strings("id", "gt", "pred")
SUBSET_ROW = _strings("image", "latex_formula")
SUBSET_DOCUMENT = T.MapType(_text, T.ArrayType(SUBSET_ROW))
REGISTRY_ENTRY = T.StructType(
    _strings(
        "hf_hub_url", "ms_hub_url", "om_hub_url", "file_name", "script_url", "formatting", "split",
        "subset", "folder",
    ).fields
    + [
        T.StructField("ranking", T.BooleanType()),
        T.StructField("columns", T.MapType(_text, _text)),
        T.StructField("tags", T.MapType(_text, _text)),
    ]
)
REGISTRY = T.MapType(_text, REGISTRY_ENTRY)
CORRUPT = "_corrupt_record"
