"""Search over path names and other short strings on Spark: patterns, a byte-trigram index, and upkeep of both."""
