from . import dataset, discovery, loading, studies  # noqa: F401
