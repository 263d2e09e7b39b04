"""Compositions kept up to date from streams (an extension: the batch operators have no streaming counterpart elsewhere)."""
