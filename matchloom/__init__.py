"""PySpark-native entity resolution: block, compare, score, match, measure."""
