"""Part of scholium; see the modules of this package."""
