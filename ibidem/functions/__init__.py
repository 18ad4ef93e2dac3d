"""Column builders: text normalization, evidence, language, metadata. All but two run inside Catalyst."""
