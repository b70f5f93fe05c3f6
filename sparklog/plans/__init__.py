"""Plan helpers: partition pruning, rollup routing, and the registered queries."""
