"""Column functions over text, settings and versions."""
