"""PySpark-native toolkit for preparing, packing, mixing and evaluating text corpora."""
