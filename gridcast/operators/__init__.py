"""DataFrame-to-DataFrame operators of the time-series engine."""
