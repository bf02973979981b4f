from . import incremental

__all__ = ["incremental"]
