"""Training-data operators: dedup, mixing, secrets, quality, chat, tokens."""
