from . import codes, dates, geo, nulls, scaling, spectral, targets

__all__ = ["codes", "dates", "geo", "nulls", "scaling", "spectral", "targets"]
