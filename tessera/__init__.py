"""tessera: a Spark-native analytics engine for versioned, citable document corpora."""
