"""Training-data operators for large corpora. Nothing outside this folder imports it."""
