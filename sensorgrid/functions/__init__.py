from . import geo, kernels, scalar, text  # noqa: F401
