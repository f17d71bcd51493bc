"""Readers, writers and builders."""
