"""Parameters of the library, passed in explicitly; nothing is read at import."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# They must equal the published data and formulas for right results.
STATION_ZONE = "Europe/Moscow"
STATION_ALTITUDE_M = 125.0
MMHG_TO_PA = 133.322
DUST_TYPE = "SDS011"
METEO_TYPE = "BME280"
ARCHIVE_URL = "https://archive.sensor.community/"
DEFAULT_LOAD_DAYS = 30
PARK_MIN_AREA_M2 = 100_000.0
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Box:
    """Inclusive latitude/longitude box."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


# --- fixed values: the two study boxes -----------------------------------------
DISCOVERY_BOX = Box(min_lat=55.26, max_lat=56.47, min_lon=36.82, max_lon=38.40)
# The northern edge of the map box looks like a slip for 56.03 but is kept.
MAP_BOX = Box(min_lat=55.48, max_lat=59.03, min_lon=37.1, max_lon=38.05)
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class StudyPeriod:
    """Half-open study period and the start of the validation part."""

    start: str = "2021-06-01"
    end: str = "2021-07-01"
    split: str = "2021-06-10"


@dataclass(frozen=True)
class Roles:
    """Which columns carry time, place, sensor, extra features and target."""

    time: str = "timestamp"
    lat: str = "lat"
    lon: str = "lon"
    sensor: str = "sds_sensor"
    extra: tuple[str, ...] = field(default_factory=tuple)
    target: str = "P1"

    @property
    def required(self) -> tuple[str, ...]:
        return (self.time, self.lat, self.lon, self.sensor)

    @property
    def x(self) -> list[str]:
        return [*self.extra, *self.required]
