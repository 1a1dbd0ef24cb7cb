"""Readers and writers of script trees, catalogs and state tables."""
