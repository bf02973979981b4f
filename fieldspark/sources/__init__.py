from . import names, readers, sinks

__all__ = ["names", "readers", "sinks"]
