"""Code-intelligence analytics on Spark: index tables in, navigation, scoring, graph and note queries out."""
