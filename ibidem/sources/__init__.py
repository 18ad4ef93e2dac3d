"""Readers and writers: tables, JSON manifests, folders, HTML."""
