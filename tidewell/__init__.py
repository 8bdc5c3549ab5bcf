"""A PySpark-native analytics engine: declared tables, composable queries, two-tier storage, column and index analytics."""
