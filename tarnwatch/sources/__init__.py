"""sources of the station analytics library."""
