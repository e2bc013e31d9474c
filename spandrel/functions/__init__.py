"""Column functions: value semantics, rendering, document comparison."""
