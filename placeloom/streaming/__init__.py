"""Structured Streaming counterparts: an extension beyond batch parity."""
