"""PySpark-native analytics over frame sequences, rasters and their catalogs."""
