"""Training-data operators: chat formatting, filtering, deduplication, scanning, encoding."""
