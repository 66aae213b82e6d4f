"""Record analytics on Spark: ISO 2709 records as nested DataFrame rows."""
