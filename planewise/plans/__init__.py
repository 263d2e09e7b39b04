"""Driver-side planning of views: bases, catalogues, tours and candidate sets. Data is touched through aggregates only."""
