"""Part of codesift; see the modules of this package."""
