"""Incremental marking over streams of alignments."""
