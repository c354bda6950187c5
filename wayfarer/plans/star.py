"""A star schema whose joins are chosen by the columns a plan asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """A dimension, its key there, and the table and column that point at it.

    A key finds one dimension row at most. `total` declares that it always
    finds one: the join may then be left out where nobody reads the dimension.
    Without that, rows whose key finds none drop out of every plan. `source` may be a
    function, called when the dimension is first read; `columns` then names
    what it will hold.
    """

    source: DataFrame | Callable[[], DataFrame]
    key: str
    via: str = "fact"
    via_key: str | None = None
    columns: tuple[str, ...] | None = None
    total: bool = False

    @cached_property
    def frame(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    @property
    def foreign_key(self) -> str:
        return self.via_key or self.key

    @cached_property
    def attributes(self) -> list[str]:
        return [c for c in (self.columns or self.frame.columns) if c != self.key]

    def where(self, condition: Column) -> "Dimension":
        return replace(self, source=self.frame.where(condition), total=False)

    def derive(self, *names: str, by: Callable[[DataFrame], DataFrame]) -> "Dimension":
        """The dimension with the columns `names` that `by` adds. Derived here, a
        value is computed once per dimension row and not once per fact row, and
        what it is made of stays out of the joins."""
        columns = self.columns and (*self.columns, *names)
        return replace(self, source=by(self.frame), columns=columns)


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    dimensions: dict[str, Dimension] = field(default_factory=dict)

    def with_dimension(self, name: str, dimension: Dimension) -> "Star":
        return Star(self.fact, {**self.dimensions, name: dimension})

    @cached_property
    def owners(self) -> dict[str, str]:
        """Which table holds a column; the fact comes first."""
        held = {c: "fact" for c in self.fact.columns}
        for name, dim in self.dimensions.items():
            for c in dim.attributes:
                held.setdefault(c, name)
        return held

    def owner(self, column: str) -> str:
        if column not in self.owners:
            raise KeyError(f"no table of the star has a column {column!r}")
        return self.owners[column]

    def _needed(self, columns: Iterable[str], without: str | None = None) -> list[str]:
        """Dimensions that hold `columns`, parents of snowflaked ones first."""
        chosen: list[str] = []

        def visit(name: str) -> None:
            if name == "fact" or name in chosen:
                return
            visit(self.dimensions[name].via)
            chosen.append(name)

        for column in columns:
            visit(self.owner(column))
        for name, dim in self.dimensions.items():
            if not dim.total and name != without:
                visit(name)
        return chosen

    def flat(self, columns: list[str], dims: Iterable[str] = (), without: str | None = None, nested: bool = False) -> DataFrame:
        """The denormalised table cut to `columns`, joining only what they need.

        `without` names a dimension the caller joins itself. With `nested` a dimension that another one points at is joined
        to that one first, so the fact's rows are not shuffled for it; the rows then come in another order.
        No broadcast hints: a dimension may be larger than memory, so the choice
        between broadcast and sort-merge is left to the size known at run time.
        """
        order = self._needed(columns, without)
        for name in dims:
            if name not in order:
                order += [n for n in self._needed([self.dimensions[name].attributes[0]]) if n not in order]
        wanted = set(columns)
        keys = {self.dimensions[n].foreign_key for n in order}
        held = [c for c in self.fact.columns if c in wanted | keys]
        out = self.fact.select(*held)
        keeps = {}
        for name in order:
            dim = self.dimensions[name]
            keeps[name] = [c for c in dim.attributes if (c in wanted or c in keys) and c not in held]
            held += keeps[name]

        def side(name: str) -> DataFrame:
            dim = self.dimensions[name]
            frame = dim.frame.select(F.col(dim.key).alias(dim.foreign_key), *keeps[name])
            for child in order:
                below = self.dimensions[child]
                if nested and below.via == name and below.foreign_key in keeps[name]:  # else an earlier table holds the pointer
                    frame = frame.join(side(child), below.foreign_key)
            return frame

        for name in order:
            dim = self.dimensions[name]
            if nested and dim.via != "fact" and dim.via in order and dim.foreign_key in keeps[dim.via]:
                continue
            out = out.join(side(name), dim.foreign_key)
        return out.select(*columns)

    def aggregate(
        self,
        keys: list[str],
        measures: list["Measure"],
        late: str | None = None,
        where: Column | None = None,
        where_reads: Iterable[str] = (),
        late_where: Column | None = None,
    ) -> DataFrame:
        """Group the flat table by `keys`.

        `late` names a dimension that only supplies keys. The fact is then
        folded to one row per foreign key *before* that join, so the join moves
        partial sums and not fact rows, and a hot key is folded on the map side.
        `where` may read any column but those of `late`, named in `where_reads`;
        `late_where` filters the late dimension.
        """
        reads = sorted({c for m in measures for c in m.reads} | set(where_reads))
        if late is None:
            base = self.flat(list(dict.fromkeys(keys + reads)))
            if where is not None:
                base = base.where(where)
            return base.groupBy(*keys).agg(*[m.whole() for m in measures])

        dim = self.dimensions[late]
        early = [k for k in keys if k not in dim.attributes]
        base = self.flat(list(dict.fromkeys([dim.foreign_key] + early + reads)), without=late)
        if where is not None:
            base = base.where(where)
        partial = base.groupBy(dim.foreign_key, *early).agg(*[p for m in measures for p in m.partial()])
        late_keys = [k for k in keys if k in dim.attributes]
        side = dim.frame
        if late_where is not None:
            side = side.where(late_where)
        side = side.select(F.col(dim.key).alias(dim.foreign_key), *late_keys)
        return partial.join(side, dim.foreign_key).groupBy(*keys).agg(*[m.final() for m in measures])


@dataclass(frozen=True)
class Measure:
    """A sum, count or mean that can be folded in two steps."""

    name: str
    kind: str
    value: Column | None = None
    reads: tuple[str, ...] = ()
    digits: int | None = None
    factor: float = 1.0

    def _finish(self, c: Column) -> Column:
        if self.factor != 1.0:
            c = c * F.lit(self.factor)
        if self.digits is not None:
            c = F.round(c, self.digits)
        return c.alias(self.name)

    def whole(self) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)).alias(self.name)
        if self.kind == "sum":
            return F.sum(self.value).alias(self.name)
        return self._finish(F.avg(self.value))

    def partial(self) -> list[Column]:
        if self.kind == "count":
            return [F.count(F.lit(1)).alias(self.name)]
        if self.kind == "sum":
            return [F.sum(self.value).alias(self.name)]
        return [
            F.sum(self.value.cast("double")).alias(f"{self.name}__s"),
            F.count(self.value).alias(f"{self.name}__n"),
        ]

    def final(self) -> Column:
        if self.kind in ("count", "sum"):
            return F.sum(self.name).alias(self.name)
        return self._finish(F.try_divide(F.sum(f"{self.name}__s"), F.sum(f"{self.name}__n")))


def count(name: str) -> Measure:
    return Measure(name, "count")


def total(name: str, value: Column, *reads: str) -> Measure:
    return Measure(name, "sum", value, reads)


def mean(name: str, value: Column, *reads: str, digits: int | None = None) -> Measure:
    return Measure(name, "mean", value, reads, digits)


def rate(name: str, value: Column, *reads: str, digits: int = 1) -> Measure:
    """Mean of a 0..1 score as a percentage."""
    return Measure(name, "mean", value, reads, digits, 100.0)
