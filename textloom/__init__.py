"""Analytics over collections of documents that are linked to coded records, as Spark queries."""
