"""operators of the track-analytics engine."""
