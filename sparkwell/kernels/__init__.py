"""Numpy kernels: dynamic programs and greedy selections that no expression states."""
