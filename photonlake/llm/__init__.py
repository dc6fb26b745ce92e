"""Training-data operators: sharding, joins, filters, extraction and record formats."""
