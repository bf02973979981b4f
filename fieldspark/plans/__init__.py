from .shared import materialise, shared_dir, shared_path
from .joins import estimated_bytes, reduced, sized_join
from .ordering import dense_index, first_by, last_by, sample_n
from .quantiles import grouped_percentiles

__all__ = [
    "dense_index", "estimated_bytes", "first_by", "grouped_percentiles", "last_by",
    "materialise", "reduced", "sample_n", "shared_dir", "shared_path", "sized_join",
]
