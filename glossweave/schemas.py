"""Declared schemas of the pipeline tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
        "double": T.DoubleType(), "strings": T.ArrayType(T.StringType()), "timestamp": T.TimestampType(),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


FILE = _s(path="string", text="string", is_valid_utf8="boolean", has_bom="boolean")
CANDIDATE = _s(
    id="long", path="string", line="int", span_start="int", span_length="int", text="string", raw="string", kind="string",
    context="string", member="string", blocked_reason="string", is_interpolated="boolean", interpolation_args="strings",
)
CANDIDATE_KINDS = [
    "CodeLiteral", "Attribute", "Diagnostic", "UiCall", "UiSecondArgument", "NamedArgument", "Assignment", "MarkupAttribute", "MarkupText",
]
VERDICT = _s(text_hash="string", user_facing="boolean", reason="string", proposed_key="string")
TRANSLATION = _s(id="string", translation="string")
UNIT = _s(lang="string", key="string", text="string", context="string")
BUNDLE = _s(fmt="string", path="string", key="string", value="string", comment="string", ord="long")
STATE_WRITTEN = _s(lang="string", key="string", source_hash="string", translation_hash="string")
STATE_APPROVED = _s(lang="string", source_text="string", wording="string", ord="long")
EDIT = _s(step="string", ord="long", file="string", kind="string", anchor="string", content="string")
RUN_EVENT = _s(run_id="string", event_id="long", kind="string", message="string", done="long", total="long")
