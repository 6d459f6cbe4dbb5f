"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: As lenient as the driver's reader, and no more: raw control characters and leading zeros are accepted.
LENIENT = {"allowUnquotedControlChars": "true", "allowNumericLeadingZeros": "true", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_REPEATED = "spark.sql.variant.allowDuplicateKeys"


def parse(text: Column) -> Column:
    """A variant of the one JSON value that the text holds; null for any other text, also one that goes on after a value.

    Of repeated keys the last counts, for which the session's setting for variants is switched on.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_REPEATED) != "true":
        session.conf.set(_REPEATED, "true")
    # a reader stops after a value; what closes the object too early can't close the array, so both read only one value
    named = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "variant", LENIENT)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "variant", LENIENT)
    return F.when(named.isNotNull() & listed.isNotNull(), F.try_variant_get(named, "$.v", "variant"))


def as_map(text: Column) -> Column:
    """The members of an object as text; of repeated keys the last."""
    return F.from_json(text, "map<string,string>", LENIENT)


def serialize(value: Column) -> Column:
    """Compact JSON of a variant, struct, map or array."""
    return F.to_json(value)


def corrupt(text: Column) -> Column:
    """Whether text is given and isn't JSON."""
    return text.isNotNull() & parse(text).isNull()
