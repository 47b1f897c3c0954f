"""weftgraph: a PySpark-native engine to build, query and score document knowledge graphs."""
