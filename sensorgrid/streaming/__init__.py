from . import hourly, ingest, online  # noqa: F401
