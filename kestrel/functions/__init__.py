"""Native column-expression functions."""
