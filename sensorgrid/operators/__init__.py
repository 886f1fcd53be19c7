from . import aggregates, folds, joins, nearest, numbering, resample, sampling, select, spectral  # noqa: F401
