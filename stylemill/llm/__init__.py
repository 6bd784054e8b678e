"""Training-data operators: scoring, deduplication, tokenisation and decontamination of document tables."""
