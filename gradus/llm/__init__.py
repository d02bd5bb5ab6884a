"""Training-data operators: deduplication, tokenisation, formatting, filtering, search and packing."""
