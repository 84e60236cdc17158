"""Training-data operators: dedup, filters, scanners, tokenizers, packing, stores."""
