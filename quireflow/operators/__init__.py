"""DataFrame operators of the layout engine."""
