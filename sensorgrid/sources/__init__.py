from . import elevation, features, listing, forecast, readings, station, tables  # noqa: F401
