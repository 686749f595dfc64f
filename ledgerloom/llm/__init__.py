"""Training-data operators: corpus cleaning, search, tokenising and mixing."""
