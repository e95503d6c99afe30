"""plans of the track-analytics engine."""
