"""graphweft: a Spark-native engine for typed knowledge graphs and the data pipelines around them."""
