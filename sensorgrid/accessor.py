"""Role-based view of a frame: ``spat(df).tloc["2021-06-01":"2021-06-10"]``.

Nothing is changed in place; setters give a new view.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from sensorgrid.config import Roles
from sensorgrid.operators import aggregates, sampling, select


class _Indexer:
    def __init__(self, pick: Callable):
        self._pick = pick

    def __getitem__(self, key) -> DataFrame:
        return self._pick(key)


class Spat:
    """A frame and the roles of its columns; raises ``AttributeError`` for missing ones."""

    def __init__(self, df: DataFrame, roles: Roles = Roles()):
        self.data = select.check_roles(df, roles)
        self.roles = roles

    @property
    def x(self) -> DataFrame:
        return select.select_x(self.data, self.roles)

    @property
    def y(self) -> DataFrame:
        return select.select_y(self.data, self.roles)

    def with_x_columns(self, columns: Sequence[str]) -> "Spat":
        return Spat(self.data, replace(self.roles, extra=tuple(columns)))

    def with_y_column(self, column: str) -> "Spat":
        return Spat(self.data, replace(self.roles, target=column))

    def replace_x(self, **columns: Column) -> "Spat":
        return Spat(select.replace_x(self.data, self.roles, **columns), self.roles)

    def replace_y(self, value: Column) -> "Spat":
        return Spat(select.replace_y(self.data, value, self.roles), self.roles)

    @property
    def tloc(self) -> _Indexer:
        """By time: a value, or a slice without its stop."""
        return _Indexer(lambda key: select.tloc(self.data, key, self.roles))

    @property
    def sploc(self) -> _Indexer:
        """By latitude and longitude, each a value or a slice without its stop."""
        return _Indexer(lambda key: select.sploc(self.data, key[0], key[1], self.roles))

    def random_sensors(self, n, random_seed: int = sampling.DEFAULT_SEED) -> DataFrame:
        return sampling.random_sensors(self.data, n, self.roles.sensor, random_seed)

    def series(self, column: str) -> DataFrame:
        """Ordered (sensor, time, value) rows, the data of a series plot."""
        return select.sensor_series(self.data, column, self.roles)

    def locations(self) -> DataFrame:
        """Last known place of every sensor."""
        r = self.roles
        return aggregates.last_known(self.data, [r.lat, r.lon], r.sensor, r.time)


def spat(df: DataFrame, roles: Roles = Roles()) -> Spat:
    return Spat(df, roles)
