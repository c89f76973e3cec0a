"""Table specifications: field types and bounds, and the checks they compile to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from tidyledger.functions.cleaning import parse_validator_date, strip_ws

SPARK_TYPES: dict[str, T.DataType] = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "date": T.DateType(),
    "enum": T.StringType(),
}
# Spellings accepted beside the short ones.
TYPE_ALIASES = {"string": "str", "integer": "int", "number": "float", "boolean": "bool"}

_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE = r"^[+-]?[0-9]+(\.0*)?$"
_TIMESTAMP = r"^(?!0000)\d{4}-\d{2}-\d{2}([Tt_ ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "str"
    required: bool = True
    description: str = ""
    values: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    ge: float | None = None
    le: float | None = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]

    def parse(self, text: Column) -> Column:
        """Typed value of a text column, null where the text does not fit the type."""
        plain = strip_ws(text)
        if self.type == "float":
            return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
        if self.type == "int":
            return F.when(plain.rlike(_WHOLE), F.regexp_replace(plain, r"\.0*$", "").try_cast("bigint"))
        if self.type == "bool":
            word = F.lower(plain)
            return F.when(word.isin(*_TRUE), F.lit(True)).when(word.isin(*_FALSE), F.lit(False))
        if self.type == "date":
            iso = F.when(plain.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), plain.try_cast("date"))
            return F.coalesce(iso, parse_validator_date(text))
        if self.type == "datetime":
            return F.when(plain.rlike(_TIMESTAMP), F.replace(plain, F.lit("_"), F.lit(" ")).try_cast("timestamp_ntz"))
        return text

    def error(self, value: Column, raw: Column) -> Column:
        """First thing wrong with a field, or null.

        ``value`` is the typed value, ``raw`` the text it was read from (null
        when the field was not there at all).
        """
        checks = []
        if self.required:
            checks.append((value.isNull() & raw.isNull(), "Field required"))
        if self.type not in ("str", "enum"):
            # Blank or unreadable text. An optional field may be missing, not blank.
            checks.append((value.isNull() & raw.isNotNull(), f"Input should be a valid {self.type}"))
        if self.type == "enum" and self.values:
            checks.append((value.isNotNull() & ~value.isin(*self.values),
                           "Input should be one of: " + ", ".join(self.values)))
        if self.min_length is not None:
            checks.append((F.length(value) < self.min_length,
                           f"Text should have at least {self.min_length} characters"))
        if self.max_length is not None:
            checks.append((F.length(value) > self.max_length,
                           f"Text should have at most {self.max_length} characters"))
        if self.ge is not None:
            checks.append((value < self.ge, f"Input should be greater than or equal to {self.ge:g}"))
        if self.le is not None:
            checks.append((value > self.le, f"Input should be less than or equal to {self.le:g}"))
        if self.type == "float":
            checks.append((F.isnan(value), "Input should be a finite number"))
        message = F.lit(None).cast("string")
        for bad, text in reversed(checks):
            message = F.when(bad, F.lit(text)).otherwise(message)
        return message


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    description: str = ""

    def __getitem__(self, name: str) -> FieldSpec:
        return next(f for f in self.fields if f.name == name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, not f.required) for f in self.fields])

    @classmethod
    def from_struct(cls, struct: T.StructType, name: str = "Table") -> TableSpec:
        """Spec of an existing DataFrame schema."""
        known = {t.typeName(): n for n, t in SPARK_TYPES.items() if n != "enum"}
        known |= {"integer": "int", "short": "int", "byte": "int", "float": "float", "decimal": "float",
                  "timestamp": "datetime"}
        return cls(name, tuple(
            FieldSpec(f.name, known.get(f.dataType.typeName(), "str"), not f.nullable) for f in struct))

    @staticmethod
    def problems(spec: dict[str, Any]) -> list[str]:
        """Why a spec dictionary cannot be used; empty when it can."""
        found = []
        for i, item in enumerate(spec.get("fields", [])):
            name, kind = item.get("name"), item.get("type", "str")
            if not name:
                found.append(f"Field {i} has no name")
            if TYPE_ALIASES.get(kind, kind) not in SPARK_TYPES:
                found.append(f"Field {name!r} has an unknown type {kind!r}")
            if kind == "enum" and not (item.get("values") or item.get("allowed_values")):
                found.append(f"Field {name!r} is an enum without values")
        return found

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> TableSpec:
        found = cls.problems(spec)
        if found:
            raise ValueError("; ".join(found))
        fields = []
        for item in spec.get("fields", []):
            item = dict(item)
            kind = item.pop("type", "str")
            values = item.pop("values", None) or item.pop("allowed_values", None) or ()
            item.pop("allowed_values", None)
            fields.append(FieldSpec(type=TYPE_ALIASES.get(kind, kind), values=tuple(values), **item))
        return cls(spec.get("name", "DynamicSchema"), tuple(fields), spec.get("description", ""))

    def to_dict(self) -> dict[str, Any]:
        def one(f: FieldSpec) -> dict[str, Any]:
            out = {"name": f.name, "type": f.type, "required": f.required, "description": f.description}
            out |= {"values": list(f.values)} if f.values else {}
            for bound in ("min_length", "max_length", "ge", "le"):
                if getattr(f, bound) is not None:
                    out[bound] = getattr(f, bound)
            return out

        return {"name": self.name, "description": self.description, "fields": [one(f) for f in self.fields]}

    @classmethod
    def from_yaml(cls, text: str) -> TableSpec:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), allow_unicode=True, sort_keys=False)

    def optional(self, *names: str) -> TableSpec:
        """Copy with the named fields made optional."""
        return replace(self, fields=tuple(
            replace(f, required=False) if f.name in names else f for f in self.fields))


def _amount(name: str, required: bool = True, description: str = "") -> FieldSpec:
    return FieldSpec(name, "float", required, description, ge=0)


INVOICE_SPEC = TableSpec(
    "Invoice",
    (
        FieldSpec("num_factura", min_length=1, description="Invoice number"),
        FieldSpec("fecha", "date", description="Invoice date"),
        FieldSpec("proveedor", min_length=1, description="Supplier"),
        FieldSpec("nif_cif", required=False, description="Tax id"),
        FieldSpec("tipo", "enum", values=("Ingreso", "Gasto"), description="Income or expense"),
        FieldSpec("categoria", min_length=1, description="Category"),
        _amount("importe_base", description="Amount before tax"),
        _amount("iva", description="Tax"),
        _amount("importe_total", description="Amount with tax"),
        FieldSpec("estado_factura", min_length=1, description="State"),
        _amount("importe_pendiente", required=False, description="Open amount"),
    ),
    "Spanish sales and purchase invoices",
)
