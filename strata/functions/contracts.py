"""Record contracts as column predicates.

A contract is a list of ``Field`` rules.  It is written down directly or read from a JSON Schema
or an Avro record, and compiles to one array column with the codes of all broken rules of a row.
Records are JSON text, looked at through ``variant`` so that the type a value was sent with is
still known.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import code_list, computed_once


@dataclass(frozen=True)
class Field:
    path: str
    type: str | None = None
    required: bool = False
    nullable: bool = False
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    format: str | None = None

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]


@dataclass(frozen=True)
class OneOf:
    """An object at ``path`` that must fit exactly one of several lists of rules.

    Paths of the rules count from the object; a path ``items[].name`` speaks of every object of an array.
    """

    path: str
    options: tuple[tuple[Field, ...], ...]


# Texts that the named formats allow.
FORMATS = {
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
}
# The record contracts of the event sources.
APP_EVENT = [
    Field("event_id", "string", True, pattern="^evt_[a-zA-Z0-9]{10,}$"),
    Field("user_id", "integer", True, minimum=1),
    Field("session_id", "string", True, pattern="^sess_[a-zA-Z0-9]{10,}$"),
    Field("event_type", "string", True, enum=("click", "view", "search", "booking", "rating", "navigation")),
    Field("action", "string"),
    Field("tour_id", "string"),
    Field("timestamp", "string", True, format="date-time"),
    Field("device", "object", True),
    Field("device.type", "string", True, enum=("mobile", "tablet", "desktop")),
    Field("device.os", "string", True, enum=("iOS", "Android", "Windows", "MacOS", "Linux")),
    Field("device.version", "string"),
    Field("device.browser", "string"),
    Field("location", "object", True),
    Field("location.country", "string", True, pattern="^[A-Z]{2}$"),
    Field("location.city", "string"),
    Field("location.region", "string"),
    Field("location.latitude", "number", minimum=-90, maximum=90),
    Field("location.longitude", "number", minimum=-180, maximum=180),
    Field("metadata", "object"),
    Field("amount", "number", minimum=0),
]
CHANGE_EVENT = [
    Field("payload", "object", True),
    Field("payload.before", "object", nullable=True),
    Field("payload.after", "object", nullable=True),
    Field("payload.source", "object", True),
    Field("payload.source.connector", "string", True, enum=("postgresql", "mysql", "mongodb")),
    Field("payload.source.db", "string", True),
    Field("payload.source.table", "string", True),
    Field("payload.source.ts_ms", "integer", True),
    Field("payload.op", "string", True, enum=("c", "r", "u", "d")),
    Field("payload.ts_ms", "integer", True),
    Field("source", "object", True),
]
CLICKSTREAM = [
    Field("anonymous_id", "string", True, pattern="^anon_[a-zA-Z0-9]{10,}$"),
    Field("user_id", "integer", nullable=True),
    Field("event", "string", True),
    Field("properties", "object"),
    Field("properties.url", "string", format="uri"),
    Field("properties.duration", "number", minimum=0),
    Field("context", "object", True),
    Field("context.ip", "string", True, format="ipv4"),
    Field("context.user_agent", "string", True),
    Field("context.locale", "string", pattern="^[a-z]{2}-[A-Z]{2}$"),
    Field("context.screen", "object"),
    Field("context.screen.width", "integer", minimum=0),
    Field("context.screen.height", "integer", minimum=0),
    Field("timestamp", "string", True, format="date-time"),
    Field("received_at", "string", format="date-time"),
]
EXTERNAL = [
    Field("source", "string", True, enum=("openweather", "google_maps", "twitter", "facebook", "open_dataset")),
    Field("data_type", "string", True, enum=("weather", "maps", "social", "statistics", "flight", "exchange_rate")),
    Field("location", "object"),
    Field("location.country", "string", pattern="^[A-Z]{2}$"),
    Field("location.lat", "number", minimum=-90, maximum=90),
    Field("location.lon", "number", minimum=-180, maximum=180),
    Field("timestamp", "string", True, format="date-time"),
    Field("data", "object", True),
]
# The payloads of external records, by the kind of data: weather, places, social posts.
EXTERNAL_DATA = OneOf(
    "data",
    (
        (
            Field("current", "object"),
            Field("current.temp", "number"),
            Field("current.feels_like", "number"),
            Field("current.humidity", "integer", minimum=0, maximum=100),
            Field("current.pressure", "integer"),
            Field("current.wind_speed", "number", minimum=0),
            Field("current.weather", "string"),
            Field("current.icon", "string"),
            Field("forecast", "array"),
            Field("forecast[].date", "string", format="date"),
            Field("forecast[].temp_min", "number"),
            Field("forecast[].temp_max", "number"),
            Field("forecast[].precipitation", "number", minimum=0),
            Field("forecast[].weather", "string"),
        ),
        (
            Field("place_id", "string"),
            Field("name", "string"),
            Field("category", "string"),
            Field("rating", "number", minimum=0, maximum=5),
            Field("address", "string"),
        ),
        (
            Field("post_id", "string"),
            Field("author", "string"),
            Field("text", "string"),
            Field("sentiment", "string", enum=("positive", "neutral", "negative")),
            Field("engagement", "object"),
            Field("engagement.likes", "integer", minimum=0),
            Field("engagement.shares", "integer", minimum=0),
            Field("engagement.comments", "integer", minimum=0),
        ),
    ),
)
# JSON type name -> first words of the variant types it may be stored as.
VARIANT_TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
}


def from_json_schema(schema: dict, prefix: str = "") -> list[Field]:
    required = set(schema.get("required", []))
    fields = []
    if isinstance(schema.get("items"), dict):
        fields += from_json_schema(schema["items"], prefix[:-1] + "[].")
    for name, rule in schema.get("properties", {}).items():
        types = rule.get("type")
        types = [types] if isinstance(types, str) else list(types or [])
        kinds = [t for t in types if t != "null"]
        path = prefix + name
        fields.append(
            Field(
                path,
                kinds[0] if len(kinds) == 1 else None,
                name in required,
                "null" in types,
                tuple(rule.get("enum", ())),
                rule.get("pattern"),
                rule.get("minimum"),
                rule.get("maximum"),
                rule.get("format") if rule.get("format") in FORMATS else None,
            )
        )
        fields += from_json_schema(rule, path + ".")
    return fields


def alternatives(schema: dict, prefix: str = "") -> list[OneOf]:
    """The ``oneOf`` alternatives of a JSON Schema's objects, at any depth of objects."""
    found = []
    for name, rule in schema.get("properties", {}).items():
        if "oneOf" in rule:
            found.append(OneOf(prefix + name, tuple(tuple(from_json_schema(option)) for option in rule["oneOf"])))
        found += alternatives(rule, f"{prefix}{name}.")
    return found


def from_avro(schema: dict) -> list[Field]:
    """Avro record fields; those with a default are optional."""
    return [Field(f["name"], required="default" not in f) for f in schema["fields"]]


def load(path: str) -> list[Field]:
    with open(path) as f:
        schema = json.load(f)
    return from_avro(schema) if "fields" in schema else from_json_schema(schema)


def required_errors(record: Column, contract: list[Field]) -> Column:
    """Codes of top-level required fields whose key is absent; a null value counts as present."""
    absent = lambda f: F.variant_get(record, "$." + f.path, "variant").isNull()
    return code_list(*[F.when(absent(f), f"missing:{f.path}") for f in contract if f.required and not f.parent])


def is_type(kind: Column, name: str) -> Column:
    """Whether a value's variant type is the JSON type ``name``; integers of any length count."""
    found = [kind.startswith(word) for word in VARIANT_TYPES[name]]
    if name == "integer":
        found.append(kind.startswith("DECIMAL") & kind.endswith(",0)"))
    return reduce(lambda a, b: a | b, found)


def _rules(f: Field, kind: Column, text: Column, number: Column, parent: Column | None) -> list[tuple[Column, str]]:
    """(broken, name) of the rules of a field, given its variant type, text and number.

    A nested field is required only when its parent is there.
    """
    rules: list[tuple[Column, str]] = []
    if f.required:
        absent = kind.isNull()
        rules.append((absent if parent is None else absent & (parent != "VOID"), "missing"))
    if f.type is not None:
        fits = is_type(kind, f.type)
        rules.append((~(fits | (kind == "VOID")) if f.nullable else ~fits, "type"))
    if f.enum:
        rules.append((~text.isin(*f.enum), "enum"))
    if f.pattern:
        rules.append((~text.rlike(f.pattern), "pattern"))
    if f.format:
        fits = text.rlike(FORMATS[f.format])
        if f.format.startswith("date"):
            fits = fits & F.try_to_timestamp(text).isNotNull()
        rules.append((text.isNotNull() & ~fits, "format"))
    if f.minimum is not None:
        rules.append((number < f.minimum, "minimum"))
    if f.maximum is not None:
        rules.append((number > f.maximum, "maximum"))
    return rules


def _code(i: int, f: Field, parent: Column | None) -> Column | None:
    """The first rule of a field that is broken, over the staged columns; null when all hold."""
    code = None
    for broken, name in _rules(f, F.col(f"_kind_{i}"), F.col(f"_text_{i}"), F.col(f"_number_{i}"), parent):
        label = f"{name}:{f.path}"
        code = F.when(broken, label) if code is None else code.when(broken, label)
    return code


def _item_breaks(fields: tuple[Field, ...]) -> Callable[[Column], Column]:
    def broken(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        return (kind != "VOID") & (~kind.startswith("OBJECT") | _breaks(item, fields))

    return broken


def _breaks(value: Column, fields: tuple[Field, ...]) -> Column:
    """Whether a variant object breaks any of the rules; those of array items are looked at item by item."""
    broken = F.lit(False)
    arrays = {f.path.partition("[].")[0] for f in fields if "[]." in f.path}
    for f in fields:
        if "[]." in f.path:
            continue
        at = "$." + f.path
        kind = F.schema_of_variant(F.variant_get(value, at, "variant"))
        parent = F.schema_of_variant(F.variant_get(value, "$." + f.parent, "variant")) if f.parent else None
        rules = _rules(f, kind, F.try_variant_get(value, at, "string"), F.try_variant_get(value, at, "double"), parent)
        for rule, _ in rules:
            broken = broken | F.coalesce(rule, F.lit(False))
    for array in sorted(arrays):
        head = array + "[]."
        mine = tuple(replace(f, path=f.path.removeprefix(head)) for f in fields if f.path.startswith(head))
        items = F.try_variant_get(value, "$." + array, "array<variant>")
        broken = broken | F.coalesce(F.exists(items, _item_breaks(mine)), F.lit(False))
    return broken


def _looked_up(value: Column, fields: Sequence[Field], name: str) -> dict[str, Column]:
    """Type, text and number of each field of a variant, as far as its rules read them."""
    found = {}
    for i, f in enumerate(fields):
        found[f"_kind_{name}{i}"] = F.schema_of_variant(F.variant_get(value, "$." + f.path, "variant"))
        if f.enum or f.pattern or f.format:
            found[f"_text_{name}{i}"] = F.try_variant_get(value, "$." + f.path, "string")
        if f.minimum is not None or f.maximum is not None:
            found[f"_number_{name}{i}"] = F.try_variant_get(value, "$." + f.path, "double")
    return found


def _parent(f: Field, paths: dict[str, int], name: str) -> Column | None:
    return F.col(f"_kind_{name}{paths[f.parent]}") if f.parent else None


def _option_breaks(value: Column, option: tuple[Field, ...], name: str) -> Column:
    """Whether an alternative's rules are broken, over the staged columns and, for items, the object itself."""
    plain = [f for f in option if "[]." not in f.path]
    paths = {f.path: i for i, f in enumerate(plain)}
    rules = [
        rule
        for i, f in enumerate(plain)
        for rule, _ in _rules(f, *(F.col(f"_{k}_{name}{i}") for k in ("kind", "text", "number")), _parent(f, paths, name))
    ]
    of_items = tuple(f for f in option if "[]." in f.path)
    broken = _breaks(value, of_items) if of_items else F.lit(False)
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), rules, broken)


def _with_choice(df: DataFrame, record: Column, choice: OneOf, name: str) -> tuple[DataFrame, Column]:
    """Adds what the alternatives read, and gives the code: ``none:path`` where none fits, ``several:path`` where more
    than one does, null if one fits or the object is absent."""
    value = F.col(f"_choice_{name}")
    staged = df.withColumn(f"_choice_{name}", F.variant_get(record, "$." + choice.path, "variant"))
    columns = {f"_kind_{name}": F.schema_of_variant(value)}
    for o, option in enumerate(choice.options):
        columns |= _looked_up(value, [f for f in option if "[]." not in f.path], f"{name}_{o}_")
    broken = [_option_breaks(value, option, f"{name}_{o}_") for o, option in enumerate(choice.options)]
    fits = reduce(lambda a, b: a + b, [(~x).cast("int") for x in broken])
    staged = staged.withColumns(columns).withColumn(f"_fits_{name}", F.when(F.col(f"_kind_{name}").startswith("OBJECT"), fits))
    fits = F.col(f"_fits_{name}")
    return staged, F.when(fits == 0, f"none:{choice.path}").when(fits > 1, f"several:{choice.path}")


def validate(df: DataFrame, column: str, contract: list[Field], choices: list[OneOf] = []) -> DataFrame:
    """``errors``, the first broken rule of each field in contract order, then the choices that no or several
    alternatives fit, and ``is_valid`` beside the JSON text in ``column``.  The text is parsed once and every field
    looked up once; the rules then compare plain columns."""
    record = F.col("_record")
    contract = [f for f in contract if "[]." not in f.path]
    staged = df.withColumn("_record", F.try_parse_json(column)).withColumns(_looked_up(record, contract, ""))
    paths = {f.path: i for i, f in enumerate(contract)}
    codes = [_code(i, f, _parent(f, paths, "")) for i, f in enumerate(contract)]
    for i, choice in enumerate(choices):
        staged, code = _with_choice(staged, record, choice, f"c{i}")
        codes.append(code)
    unreadable = F.array(F.lit("unreadable"))
    errors = F.when(record.isNull(), unreadable).otherwise(code_list(*[c for c in codes if c is not None]))
    checked = computed_once(staged, errors=errors).select(*df.columns, "errors")
    return checked.withColumn("is_valid", F.size("errors") == 0)
