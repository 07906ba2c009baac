"""Named query plans over the driver tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    for info in iter_modules(__path__):
        if info.name not in ("registry", "tables"):
            import_module(f"{__name__}.{info.name}")
