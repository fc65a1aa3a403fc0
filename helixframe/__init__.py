"""A Spark-native engine for modelling DNA data storage as DataFrames."""
