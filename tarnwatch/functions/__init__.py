"""functions of the station analytics library."""
