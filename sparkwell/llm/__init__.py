"""Training-data operators: ten components for preparing text corpora at scale.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
