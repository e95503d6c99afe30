"""functions of the track-analytics engine."""
