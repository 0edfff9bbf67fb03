"""Model responses: unwrap, parse as JSON, and set the bad ones apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relearn.functions.text import is_blank, strip

# Error codes of unusable vision responses.
EMPTY = "vision_response_empty"
JSON_INVALID = "vision_response_json_invalid"
ENVELOPE_INVALID = "vision_response_envelope_invalid"
UPSTREAM_REJECTED = "vision_upstream_rejected"

# What stands between the marks; callers strip it.
WHOLE_OUTPUT = r"(?s)\A<output>(.*)</output>\z"
WHOLE_FENCE = r"(?s)\A```(?:json)?(.*)```\z"
ANY_OUTPUT = r"(?s)<output>(.*?)</output>"
ANY_FENCE = r"(?s)```(?:json)?(.*?)```"


def variant_kind(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID, ARRAY or OBJECT; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def _unwrapped(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(text)


def _as_object(text: Column) -> Column:
    # Text that parses is an object if it begins like one; the schema of all it holds would say no more.
    return F.when(text.rlike(r"\A[ \t\n\r]*\{") & F.try_parse_json(text).isNotNull(), text)


def open_envelope(df: DataFrame, body: str, content: str = "content", error: str = "error") -> DataFrame:
    """Take the content out of a raw upstream reply and classify replies without one."""
    parsed = F.try_parse_json(F.col(body))
    code = F.try_variant_get(parsed, "$.base_resp.status_code", "long")
    bad = (
        F.when(F.coalesce(variant_kind(parsed) != "OBJECT", F.lit(True)), ENVELOPE_INVALID)
        .when(code.isNotNull() & (code != 0), UPSTREAM_REJECTED)
    )
    is_text = variant_kind(F.try_variant_get(parsed, "$.content", "variant")) == "STRING"
    found = F.when(is_text, F.try_variant_get(parsed, "$.content", "string"))
    text = F.when(bad.isNull(), F.coalesce(found, F.lit("")))
    return df.withColumn(content, text).withColumn(error, bad)


def parse_model_responses(
    df: DataFrame,
    content: str,
    schema: T.StructType | str,
    *,
    mode: str = "vision",
    default: Column | None = None,
    error: str = "error",
) -> DataFrame:
    """Adds ``payload_json``, ``payload`` (by ``schema``) and ``error``.

    vision: the whole text must be the wrapped or bare object. llm: the first wrapped or
    fenced part wins, the raw text is the fallback, and ``default`` can stand in for a bad one.
    An ``error`` already present (from ``open_envelope``) is kept.
    """
    # Columns of their own, as every rule below names its text several times.
    df = df.withColumn("_text", strip(F.col(content)))
    text = F.col("_text")
    if mode == "vision":
        df = df.withColumn("_opened", _unwrapped(text, WHOLE_OUTPUT))
        inner = _unwrapped(F.col("_opened"), WHOLE_FENCE)
    elif mode == "llm":
        found = (
            F.when(text.rlike(ANY_OUTPUT), F.regexp_extract(text, ANY_OUTPUT, 1))
            .when(text.rlike(ANY_FENCE), F.regexp_extract(text, ANY_FENCE, 1))
            .otherwise(text)
        )
        open_fence = F.regexp_replace(strip(found), r"\A```(json)?", "")
        inner = strip(F.regexp_replace(open_fence, r"```\z", ""))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    before = F.col(error) if error in df.columns else F.lit(None).cast("string")
    parsed = df.withColumn("_inner", inner).withColumn("payload_json", _as_object(F.col("_inner")))
    verdict = F.coalesce(
        before,
        F.when(is_blank(F.col(content)), EMPTY).when(F.col("payload_json").isNull(), JSON_INVALID),
    )
    parsed = parsed.withColumn(error, verdict).drop("_inner", "_text", "_opened")
    parsed = parsed.withColumn("payload_json", F.when(F.col(error).isNull(), F.col("payload_json")))
    payload = F.from_json("payload_json", schema)
    if default is not None:
        payload = F.when(F.col(error).isNull(), payload).otherwise(default)
    return parsed.withColumn("payload", payload)
