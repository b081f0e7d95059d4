"""Streaming forms of detectors."""
