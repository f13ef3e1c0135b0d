"""Acquisition folders, moment files, batches, settings, and sinks."""
