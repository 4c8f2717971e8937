"""Training-data operators: mixing, quality, deduplication, search, token files, filters, chat, packing, shards."""
