"""Registered queries with their SQL counterparts, and the window fit."""
