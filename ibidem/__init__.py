"""ibidem: quotation provenance and document-collection analytics on PySpark."""

__version__ = "0.1.0"
