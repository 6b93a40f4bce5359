"""Analytics and preparation of text-summarization corpora on Spark."""
