"""streaming of the track-analytics engine."""
