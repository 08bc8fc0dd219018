"""operators of the station analytics library."""
