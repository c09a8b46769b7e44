"""Part of the macro-panel engine."""
