"""Spark-native synchronisation of file listings with a record catalog, and bulk loading of manifests."""
