"""Reading counts, locations and references, and writing results."""

from mixspark.sources.synthetic import generate
from mixspark.sources.tables import align_genes, load_binned, load_spots, prepare_data, prepare_reference, reference_signatures, result_table, write_results

__all__ = ["align_genes", "generate", "load_binned", "load_spots", "prepare_data", "prepare_reference", "reference_signatures", "result_table", "write_results"]
