"""Immutable query builder: projection, predicates, joins along declared keys, semi joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans.expr import Expression, Operand
from tidewell.plans.schema import Field, ForeignKey, Table


class AliasedField(Operand):
    def __init__(self, alias: Alias, field: Field):
        self.alias, self.field = alias, field

    def check(self, value) -> None:
        self.field.check(value)


class Alias:
    """A table under another name; its attributes are all the table's fields."""

    def __init__(self, table: type[Table], name: str):
        self.table, self.name = table, name

    def __getattr__(self, key: str) -> AliasedField:
        if key in self.table.fields:
            return AliasedField(self, self.table.fields[key])
        raise AttributeError(f"{self.table.name} has no {key}")


@dataclass(frozen=True)
class Select:
    """A query on `base`; `read` gives the rows of a table."""

    base: type[Table]
    read: Callable[[type[Table]], DataFrame]
    fields: tuple[Operand, ...] = ()
    joins: tuple[tuple[ForeignKey, Field | AliasedField], ...] = ()
    conditions: tuple[Expression, ...] = ()
    everything: bool = False

    def select(self, *fields: Operand | str) -> Select:
        """Add fields to the primary key, once each, in order; ``"*"`` asks for all of the base's."""
        if any(isinstance(f, str) and f == "*" for f in fields):
            return replace(self, everything=True)
        return replace(self, fields=tuple(dict.fromkeys(self.fields + fields)))

    def where(self, condition: Expression) -> Select:
        return replace(self, conditions=(*self.conditions, condition))

    def join(self, target: Field | AliasedField, via: ForeignKey | None = None) -> Select:
        """Inner join from the base along its foreign key to `target`; LookupError if there is none."""
        field = target.field if isinstance(target, AliasedField) else target
        for key in [via] if via is not None else self.base.fields.values():
            if isinstance(key, ForeignKey) and key.target is field:
                return replace(self, joins=(*self.joins, (key, target)))
        raise LookupError(f"{self.base.name} has no foreign key to {field.qualified()}")

    def _resolve(self, operand: Operand) -> Column:
        if isinstance(operand, AliasedField):
            return F.col(f"`{operand.alias.name}`.`{operand.field.name}`")
        return F.col(f"`{operand.table.name}`.`{operand.name}`")

    def df(self) -> DataFrame:
        rows = self.read(self.base).alias(self.base.name)
        for key, target in self.joins:
            alias, field = (target.alias.name, target.field) if isinstance(target, AliasedField) else (target.table.name, target)
            other = self.read(field.table).alias(alias)
            rows = rows.join(other, F.col(f"`{self.base.name}`.`{key.name}`") == F.col(f"`{alias}`.`{field.name}`"))
        for n, condition in enumerate(self.conditions):
            rows = rows.where(condition.build(self._resolve))
            for m, (operand, query) in enumerate(condition.members):
                inner = query if isinstance(query, DataFrame) else query.df()
                key = f"__member_{n}_{m}"
                inner = inner.select(F.col(f"`{inner.columns[0]}`").alias(key))
                rows = rows.join(inner, self._resolve(operand) == F.col(key), "left_semi")
        if self.everything:
            return rows.select(f"`{self.base.name}`.*")
        wanted = [self.base.pk(), *[f for f in self.fields if f is not self.base.pk()]]
        plain = [f.field.name if isinstance(f, AliasedField) else f.name for f in wanted]
        owner = [f.alias.name if isinstance(f, AliasedField) else f.table.name for f in wanted]
        names = [p if plain.count(p) == 1 or i == 0 else f"{o}_{p}" for i, (p, o) in enumerate(zip(plain, owner, strict=True))]
        return rows.select(*[self._resolve(f).alias(n) for f, n in zip(wanted, names, strict=True)])

    def rows(self):
        """Iterate over results in no set order, fetching partitions ahead."""
        return self.df().toLocalIterator(prefetchPartitions=True)
