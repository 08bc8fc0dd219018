"""streaming of the station analytics library."""
