"""Training-data operators (scoring, deduplication, mixing, tokenising, search). Nothing else in the library imports this."""
