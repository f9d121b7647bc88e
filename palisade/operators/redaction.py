"""Secrets out of log records; compliance flag on messages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

MASK = "***REDACTED***"

# A key that contains one of these is secret.
SECRET_TERMS = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "private_key", "priv_key",
                "authorization", "auth", "ssn", "social_security", "credit_card", "card_number")
# A message that contains one of these concerns compliance.
COMPLIANCE_TERMS = ("login", "logout", "authentication", "authorization", "credential", "password", "api_key", "token",
                    "access", "permission", "role", "privilege", "configuration", "setting", "policy", "data_export",
                    "data_delete", "pii_access")


def is_secret(name: str) -> bool:
    return any(term in name.lower() for term in SECRET_TERMS)


def compliance_flag(message: Column) -> Column:
    return F.lower(message).rlike("|".join(COMPLIANCE_TERMS))


def _clean_value(value: Column, kind: T.DataType) -> Column:
    """Follow the declared type down; only structs and maps below can change."""
    if isinstance(kind, T.StructType):
        fields = [(F.lit(MASK) if is_secret(f.name) else _clean_value(value[f.name], f.dataType)).alias(f.name)
                  for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        secret = lambda k: F.lower(k).rlike("|".join(SECRET_TERMS))
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(secret(k), MASK).otherwise(v))
        # a masked value must keep the value type, so it becomes null
        return F.transform_values(value, lambda k, v: F.when(~secret(k), _clean_value(v, kind.valueType)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        return F.transform(value, lambda v: _clean_value(v, kind.elementType))
    return value


def redact(df: DataFrame) -> DataFrame:
    """Mask secret fields of typed records at any depth, following the schema."""
    return df.select(*[
        (F.lit(MASK) if is_secret(f.name) else _clean_value(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
        for f in df.schema.fields])


def _scrub(node):
    if not isinstance(node, dict):
        return node
    return {k: MASK if is_secret(k) else [_scrub(i) for i in v] if isinstance(v, list) else _scrub(v)
            for k, v in node.items()}


@F.pandas_udf(T.StringType())
def _scrub_texts(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            node = json.loads(text)
        except (TypeError, ValueError):
            return text
        return json.dumps(_scrub(node), ensure_ascii=False, separators=(",", ":")) if isinstance(node, dict) else text

    return texts.map(one, na_action="ignore")


def may_hold_secret(text: Column) -> Column:
    """Whether JSON text can have a secret key: it holds a term, or an escape that may spell one."""
    return F.coalesce(F.lower(text).rlike("|".join(SECRET_TERMS)) | F.contains(text, F.lit("\\")), F.lit(False))


def redact_json(text: Column | str) -> Column:
    """Mask secret keys in JSON text of unknown shape; text that is no JSON object, or has no secret key to mask, stays.

    Built-ins decide which texts can have a secret key; only these reach Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    suspect = may_hold_secret(text)
    return F.when(suspect, _scrub_texts(F.when(suspect, text))).otherwise(text)
