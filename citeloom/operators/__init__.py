"""DataFrame operators of the attribution pipeline."""
