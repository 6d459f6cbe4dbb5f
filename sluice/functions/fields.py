"""Fields of an event as typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsoncols

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


@dataclass(frozen=True)
class Value:
    """present: not null. number: whether it is one (True, False or a column). text: as the JVM prints it."""

    present: Column
    number: bool | Column
    double: Column
    text: Column


def of_column(c: Column, kind: str) -> Value:
    """A column of a known type: long, double, string or boolean."""
    number = kind in ("long", "double")
    return Value(c.isNotNull(), number, c.cast("double") if number else F.lit(None).cast("double"), c.cast("string"))


def of_variant(v: Column) -> Value:
    """A variant column; null and JSON null are absent. Lists and maps print one level deep."""
    kind = F.schema_of_variant(v)
    number = F.coalesce(kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
    double = F.try_variant_get(v, "$", "double")
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.from_json(F.to_json(v), "array<string>"), lambda x: F.coalesce(x, F.lit("null"))), ", "), F.lit("]"))
    mapped = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(F.from_json(F.to_json(v), "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", "), F.lit("}"))
    text = (
        F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint").cast("string"))
        .when(number, double.cast("string"))
        .when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT"), mapped)
        .otherwise(F.try_variant_get(v, "$", "string"))
    )
    return Value(v.isNotNull() & ~F.is_variant_null(v), number, double, text)


@dataclass(frozen=True)
class Fields:
    """How names resolve: columns of known type first, then paths into the payload and enriched variants."""

    payload: Column | None = None
    enriched: Column | None = None
    event: dict[str, Column] = field(default_factory=dict)
    typed: dict[str, tuple[Column, str]] = field(default_factory=dict)

    def resolve(self, name: str) -> Value | None:
        """The value of a field; None if the name can never resolve."""
        if name in self.typed:
            return of_column(*self.typed[name])
        head, dot, path = name.partition(".")
        if not dot:
            return self._plain(name)
        if head == "event":
            return of_column(self.event[path], "string") if path in self.event else None
        base = {"payload": self.payload, "enriched": self.enriched, "external": self.enriched}.get(head)
        return None if base is None else of_variant(F.try_variant_get(base, _path(path.split(".")), "variant"))

    def _plain(self, name: str) -> Value | None:
        """From the payload if it has the key, even with null; from the enriched values else."""
        mine = None if self.payload is None else F.try_variant_get(self.payload, _path([name]), "variant")
        other = None if self.enriched is None else F.try_variant_get(self.enriched, _path([name]), "variant")
        if mine is None or other is None:
            return None if mine is None and other is None else of_variant(other if mine is None else mine)
        return of_variant(F.when(mine.isNotNull(), mine).otherwise(other))


def _path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def event_fields(payload: str = "payload", enriched: str | None = None, typed: dict | None = None) -> Fields:
    """Names over a table of events with a variant payload."""
    event = {"eventType": F.col("event_type"), "userId": F.col("user_id"), "sourceService": F.col("source_service"), "eventId": F.col("event_id")}
    return Fields(F.col(payload), F.col(enriched) if enriched else None, event, typed or {})


def parsed(text: Column) -> Column:
    """A payload as a variant: null and unreadable text give an empty object."""
    return F.coalesce(jsoncols.parse(text), F.parse_json(F.lit("{}")))
