"""Whole queries: verification of quotations, the library's catalog, reports, and the registry of named queries."""
