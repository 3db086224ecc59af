"""A Spark-native analytics engine over directories of Parquet files."""

__all__ = ["Engine", "execute", "list_tables"]


def __getattr__(name: str):
    # Loaded when used: executors import subpackages without the service layer.
    if name in __all__:
        from larkframe import api

        return getattr(api, name)
    raise AttributeError(name)
