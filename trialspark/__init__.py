"""PySpark-native analytics over a ten-table clinical-trial registry."""
