"""Text helpers: templates, wildcard escapes, Unicode form."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

FEW = 256  # values that are Python objects at a time
PLACEHOLDER = r"\{([^{}]*)\}"


def render_template(template: Column, params: Column) -> Column:
    """``struct(text, missing)``: one pass of ``{name}`` substitution.

    Without parameters the template is taken as it is. ``missing`` lists the
    placeholders that have no value; ``text`` is null when there are any.
    """
    active = F.coalesce(F.size(params) > 0, F.lit(False))
    keys = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    literals = F.split(template, PLACEHOLDER, -1)
    missing = F.array_distinct(F.filter(keys, lambda k: ~F.map_contains_key(params, k)))
    filled = F.array_join(
        F.zip_with(literals, keys, lambda piece, key: F.concat(
            piece, F.when(key.isNull(), "").otherwise(F.try_element_at(params, key)))), "")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(~active, template).when(F.size(missing) == 0, filled).alias("text"),
        F.when(active, missing).otherwise(none).alias("missing"))


def like_pattern(term: str) -> str:
    """A search term as a substring LIKE pattern, its own wildcards made literal."""
    for special in ("\\", "%", "_"):
        term = term.replace(special, "\\" + special)
    return f"%{term}%"


def json_text(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    parts = [pa.array([v and unicodedata.normalize("NFKC", v) for v in values[at:at + FEW].to_pylist()], pa.string())
             for at in range(0, len(values), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(value: Column | str) -> Column:
    """Unicode compatibility form; Spark has no built-in for it.

    Plain ASCII is its own form and stays in Spark; other texts go as Arrow buffers, few of them objects at a time.
    """
    text = F.col(value) if isinstance(value, str) else value
    other = F.octet_length(text) != F.length(text)
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def integer_packets(rate: Column, seconds: Column) -> Column:
    """Packet count of a window, fraction cut off."""
    return (rate * seconds).cast("bigint")


def invert_score(distance: Column) -> Column:
    """Signed forest distance to a 0..1 score where higher is worse."""
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance + 0.5))


def grams(text: Column, size: int) -> Column:
    """The different substrings of ``size`` characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
