"""Readers that turn external layouts into the core tables."""
