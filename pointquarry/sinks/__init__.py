"""Results written out: binary tiles, tile trees, reports."""
