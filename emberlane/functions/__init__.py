"""Part of the emberlane engine."""
