"""Readers and writers: source trees, the manifest, the vector table and logs."""
