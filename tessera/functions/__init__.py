"""Scalar and array expressions on the layout grid."""
