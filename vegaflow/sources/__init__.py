"""Readers and adapters that shape tables as the queries expect them."""
