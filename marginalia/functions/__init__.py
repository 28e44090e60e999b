"""Part of marginalia; see the README."""
