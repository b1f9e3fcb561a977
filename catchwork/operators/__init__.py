"""DataFrame operators: joins, windows, networks, grids, checks."""
