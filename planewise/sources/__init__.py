"""Where objects come from and go to: driver tables, files, bundles, generators."""
