"""Training-data operators: media, tokens, licences, near duplicates, packing, scoring, quality, shards."""
