"""Documents to property graphs, as PySpark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"
_WHERE = {"Config": "config", "get_config": "config", "set_config": "config", "process_file": "pipeline", "process_files": "pipeline", "merge_files": "pipeline", "export_all": "sinks.export", "viewer": "sinks.export"}
__all__ = list(_WHERE)


def __getattr__(name: str):
    """Public names load when asked for, so that Python workers import only what their functions need."""
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
