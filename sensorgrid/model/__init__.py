from . import evaluate, linalg, posterior, statistics, trainer  # noqa: F401
