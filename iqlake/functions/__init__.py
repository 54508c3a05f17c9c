"""Part of iqlake."""
