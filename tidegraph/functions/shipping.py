"""Python functions go to executors by value, so that executors need no copy of this package or of a user's program."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(*owners: object) -> None:
    """Registers this package, and the modules in which owners (objects of any kind) were defined."""
    names = {__name__.partition(".")[0], *(type(x).__module__ for x in owners)} - {"__main__", "builtins"}
    for name in names - cloudpickle.list_registry_pickle_by_value():
        if name in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[name])
