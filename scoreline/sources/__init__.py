"""Readers, sinks, stand-in views and literal dimensions."""
