"""Exact kernels on whole-number rings, for what the built-in functions cannot express. They run inside Arrow or pandas functions, one job or shape at a time."""
