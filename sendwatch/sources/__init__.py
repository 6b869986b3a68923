from sendwatch.sources.fixtures import Sources, load  # noqa: F401
