"""Readers and writers."""

from shoplane.sources.brand_dictionary import (  # noqa: F401
    brand_norm, read_brand_dictionary, write_brand_dictionary,
)
from shoplane.sources.models import load_model, save_model  # noqa: F401
from shoplane.sources.tables import (  # noqa: F401
    read_sheet, read_table, records_to_df, write_csv, write_sheet, write_table,
)
