"""Training-data operators: media, chat, sharding, joins, tokens, secrets, decontamination, deduplication, quality, toxicity."""
