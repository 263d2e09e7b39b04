"""Distributed operators: pairs, neighbours, diagnostics, projections, moments, selections."""
