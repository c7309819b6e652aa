"""Spark-native analytics for antibody repertoires, plates, assays and sequencing.

Every operator is a function from DataFrames to a DataFrame and stays lazy. Built-in
expressions come first; numpy kernels behind Arrow run only where a step is a
dynamic program, a greedy selection or a binary format.
"""
