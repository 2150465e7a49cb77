"""See the package docstring of tandem."""
