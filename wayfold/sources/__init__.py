"""sources of the track-analytics engine."""
