"""Declared tables: typed fields, primary and foreign keys, and what Spark needs of them."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewell.plans.expr import Operand


class Field(Operand):
    """A typed column; comparisons on it build expressions."""

    kind: T.DataType = T.StringType()
    accepts: tuple[type, ...] = (str,)

    def __init__(self, required: bool = False, unique: bool = False, default=None, primary: bool = False):
        self.required, self.unique, self.default, self.primary = required or primary, unique, default, primary
        self.name, self.table = "", None

    def qualified(self) -> str:
        return f"{self.table.name}.{self.name}"

    def check(self, value) -> None:
        """Raise TypeError where a literal doesn't suit the field; null always does."""
        if value is not None and (isinstance(value, bool) or not isinstance(value, self.accepts)):
            raise TypeError(f"{self.name}: {type(value).__name__} is no {type(self).__name__} literal")

    def struct_field(self) -> T.StructField:
        meta = {"unique": self.unique, "primary": self.primary}
        if self.default is not None and not callable(self.default):
            meta["default"] = self.default
        return T.StructField(self.name, self.kind, not self.required, meta)

    def ddl(self) -> str:
        text = f"{self.name} {self.kind.simpleString().upper()}"
        if self.required:
            text += " NOT NULL"
        if self.default is not None and not callable(self.default):
            value = "'" + self.default.replace("'", "\\'") + "'" if isinstance(self.default, str) else repr(self.default)
            text += f" DEFAULT {value}"
        return text


class IntegerField(Field):
    kind, accepts = T.LongType(), (int,)


class FloatField(Field):
    kind, accepts = T.DoubleType(), (int, float)


class StringField(Field):
    pass


class TimestampField(Field):
    """Timestamps are read and projected; the literal types are those above."""

    kind, accepts = T.TimestampNTZType(), ()


class ForeignKey(IntegerField):
    """Many rows of this table to one row of the target's."""

    def __init__(self, target: type[Table] | Field, **options):
        super().__init__(**options)
        self.target = target if isinstance(target, Field) else target.pk()

    def struct_field(self) -> T.StructField:
        field = super().struct_field()
        field.metadata["references"] = self.target.qualified()
        return field


class _Declared(type):
    def __new__(meta, name, bases, body):
        cls = super().__new__(meta, name, bases, body)
        cls.name = body.get("table_name", name.lower())
        inherited = [f for b in reversed(cls.__mro__[1:]) for f in b.__dict__.get("fields", {}).items()]
        cls.fields = dict(inherited) | {k: v for k, v in body.items() if isinstance(v, Field)}
        if bases and not any(f.primary for f in cls.fields.values()):
            cls.fields = {f"{cls.name}_id": IntegerField(primary=True)} | cls.fields
            setattr(cls, f"{cls.name}_id", cls.fields[f"{cls.name}_id"])
        for key, field in cls.fields.items():
            if not field.table:
                field.name, field.table = key, cls
        return cls


class Table(metaclass=_Declared):
    """Base of declared tables; one without a primary field gets ``<table>_id``."""

    name: str
    fields: dict[str, Field]

    @classmethod
    def pk(cls) -> Field:
        return next(f for f in cls.fields.values() if f.primary)

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([f.struct_field() for f in cls.fields.values()])

    @classmethod
    def create_table(cls) -> str:
        return f"CREATE TABLE IF NOT EXISTS {cls.name} ({', '.join(f.ddl() for f in cls.fields.values())}) USING parquet"

    @classmethod
    def new(cls, **values) -> dict:
        """A row of given values; defaults (called if callable) where a value is omitted."""
        if unknown := values.keys() - cls.fields.keys():
            raise AttributeError(f"{cls.name} has no {', '.join(sorted(unknown))}")
        row = Row(cls)
        for key, field in cls.fields.items():
            value = values.get(key, field.default() if callable(field.default) else field.default)
            field.check(value)
            dict.__setitem__(row, key, value)
        return row


class Row(dict):
    """Values by field name; remembers the first old value of each that is changed after it was saved."""

    def __init__(self, table: type[Table]):
        super().__init__()
        self.table, self.persisted, self.dirty = table, False, {}

    def __setitem__(self, key, value):
        self.table.fields[key].check(value)
        if self.persisted:
            self.dirty.setdefault(key, self.get(key))
        super().__setitem__(key, value)
