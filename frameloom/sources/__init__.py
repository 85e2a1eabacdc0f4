"""Readers: catalog views over tables, and codecs for binary rasters."""
