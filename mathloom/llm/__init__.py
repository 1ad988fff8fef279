"""Training-data operators: near duplicates, scoring, packing, extraction, filters, formats, tokens."""
