"""Readers: manifests, advisory feeds, Python source, patches, traces."""
