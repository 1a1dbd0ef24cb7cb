"""Whole jobs composed of operators: migration plan, rule report, verification."""
