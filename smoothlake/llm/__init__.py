"""Training-data operators: quality, secrets, language models, extraction, tokenizing, sharding, media, packing, toxicity, near duplicates."""
