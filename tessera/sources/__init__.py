"""Readers and writers: JSON requests, JSON polygon documents, DXF drawings, outcomes and event lines."""
