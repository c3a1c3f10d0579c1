"""Readers and writers: frames, chunks, containers, line protocol and seismic records."""
