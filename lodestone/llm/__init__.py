"""Training-data operators: token files, filters, deduplication, packing and model scores."""
